"""Common tokens are evidence as long as they aren't generic words."""

from lotwise.plans import matching


def test_common_tokens_give_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "PART", 7)
    left = [(i, f"Alfatrade n{i:04d}") for i in range(40)] + [(100, "Bank Omega"), (101, "OOO Gamma"), (102, None), (103, "Gamma Omega")]
    right = [(1000 + i, f"OOO Alfatrade n{i:04d}") for i in range(30)] + [(2000, "Bank Delta"), (2001, "Омега гамма"), (2002, "gamma gamma")]
    generic = {"bank", "ooo"}
    tokens = lambda x: {t for t in (x or "").lower().replace("омега", "omega").replace("гамма", "gamma").split() if len(t) >= 4 and t not in generic}
    want = sorted((i, o, ",".join(sorted(tokens(a) & tokens(b)))) for i, a in left for o, b in right if tokens(a) & tokens(b))
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    assert len(want) == 40 * 30 + 5
    assert sorted(map(tuple, matching.token_candidates(frame(left), frame(right)).collect())) == want
