import random

from cuespark.operators import reports


def test_similar_models_by_hand(spark):
    rng = random.Random(1)
    piece = lambda: rng.choice(["gpt", "Qwen", "7b", "4", "chat", "-", "_", "a", "llama", "instruct"])
    name = lambda: "".join(piece() for _ in range(rng.randint(0, 5)))
    wanted, known = [name() for _ in range(60)] + ["", "-", "_x", None], [name() for _ in range(90)] + ["gpt-4", "gpt-4", None]
    want = []
    for m in {w for w in wanted if w is not None}:
        low, pack = m.lower(), m.lower().replace("-", "").replace("_", "")
        rows = []
        for k in known:
            if k is not None:
                mid = k.lower()
                score = 100 * bool(low and low in mid) + 80 * bool(pack and pack in mid.replace("-", "").replace("_", "")) + 10 * sum(len(w) >= 3 and w in mid for w in low.replace("_", "-").split("-"))
                if score:
                    rows.append((-score, k))
        want += [(m, k, -s, i + 1) for i, (s, k) in enumerate(sorted(rows)[:5])]
    df = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    found = reports.similar_models(df(wanted, "model"), df(known, "id"))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert reports.similar_models(df([], "model"), df(known, "id")).count() == 0 and reports.similar_models(df(wanted, "model"), df([], "id")).count() == 0
