"""Orders hold every row, and search texts all that the reference keeps of them."""

from lotwise import catalog
from lotwise.plans import identity
from lotwise.session import table

SMALL = "/root/testdata/sf0.001"


def test_orders_of_all_rows(spark):
    orders = {r.o_orderkey: r for r in table(spark, SMALL, "orders").collect()}
    leads = [tuple(r) for r in catalog.queries()["t04_leads_first"](spark, SMALL).collect()]
    assert leads == sorted(((k, r.o_orderstatus == "P") for k, r in orders.items()), key=lambda x: (not x[1], x[0]))
    lots = catalog.queries()["t02_price_then_deadline"](spark, SMALL).collect()
    assert len(lots) == len(orders) > 50
    order = [(r.price or 0.0, r.deadline is None, r.deadline, r.id) for r in lots]
    assert order == sorted(order)


def test_search_texts_of_2000_characters(spark):
    want = {r.id: " ".join(" ".join((r.title, r.organization, r.search_text)).split())[:2000] for r in identity.lots(spark, SMALL).collect()}
    got = {r.id: r.search_text for r in catalog.queries()["p10_search_text"](spark, SMALL).collect()}
    assert got == want and max(map(len, got.values())) == 2000
