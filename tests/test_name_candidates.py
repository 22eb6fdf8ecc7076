"""Aliases are found anywhere in a supplier's normal name."""

from lotwise.plans import registry


def test_alias_within_a_name(spark):
    suppliers = ["OOO Alfatrade", "Alfatrade", "ЗАО «Альфа-Трейд» (Ташкент)", "Alfa", "abcabcabcabc", None, ""]
    aliases = ["Alfatrade", "альфа трейд", "Alfa", "abcabc", "Ташкент", "alfatraders", None]
    s, a = spark.createDataFrame([(x,) for x in suppliers], "supplier string"), spark.createDataFrame([(x,) for x in aliases], "alias string")
    normal = lambda x: "".join(c for c in (x or "").casefold() if c.isalnum())
    want = sorted((x, y) for x in suppliers for y in aliases if len(normal(y)) >= 6 and normal(y) in normal(x))
    assert ("OOO Alfatrade", "Alfatrade") in want and len(want) == 5
    assert sorted(map(tuple, registry.name_candidates(s, a).collect())) == want
