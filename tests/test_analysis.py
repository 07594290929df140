import itertools

from stockroom.operators import baskets, matching
from stockroom.streaming import inventory_stream as st


def test_rules_match_brute_force(spark):
    data = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"], ["d"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "id int, items array<string>")
    its = baskets.frequent_itemsets(df, min_support=0.3)
    n = len(data)
    sup = {}
    for k in range(1, 4):
        for combo in itertools.combinations("abcd", k):
            s = sum(set(combo) <= set(b) for b in data) / n
            if s >= 0.3:
                sup[combo] = s
    got = {tuple(r["items"]): r["support"] for r in its.collect()}
    assert got == sup
    rules = baskets.association_rules(its, 0.1)
    want = set()
    for items, s in sup.items():
        for k in range(1, len(items)):
            for a in itertools.combinations(items, k):
                c = tuple(x for x in items if x not in a)
                conf = s / sup[a]
                if conf >= 0.1:
                    want.add((a, c, round(conf, 9), round(conf / sup[c], 9)))
    got = {(tuple(r["antecedent"]), tuple(r["consequent"]), round(r["confidence"], 9), round(r["lift"], 9))
           for r in rules.collect()}
    assert got == want


def test_item_matching_tiers(spark):
    items = spark.createDataFrame(
        [("ROYAL STAG WHISKY 750 - ML", "ROYAL STAG WHISKY", 750), ("ROYAL STAG WHISKY 180 - ML", "ROYAL STAG WHISKY", 180),
         ("OLD MONK RUM 750 - ML", "OLD MONK RUM", 750)], "stock_item_name string, brand string, size_ml int")
    req = spark.createDataFrame([(1, "royal stag one eighty ml"), (2, "royal whiskey 375"), (3, "monk"), (6, "royal stag 180 milliliters"),
                                 (4, "the ml"), (5, "vodka")], "request_id int, text string")
    got = {r["request_id"]: (r["matched_item"], r["tier"]) for r in matching.match_items(req, items).collect()}
    assert got[1] == (None, None)                         # 'eighty' is not a number word; no item has it
    assert got[2] == ("ROYAL STAG WHISKY 180 - ML", 4)   # no 375 ml: size ignored, smallest name
    assert got[3] == ("OLD MONK RUM 750 - ML", 1)
    assert got[4] == ("OLD MONK RUM 750 - ML", 1)         # only ignored words: every item matches
    assert got[5] == (None, None)
    assert got[6] == ("ROYAL STAG WHISKY 180 - ML", 1)


def test_stream_equals_batch_replay(spark):
    out = st.run_on_events(spark, "/root/testdata/sf0.001")
    from pyspark.sql import functions as F
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("q", F.floor("value").cast("long"))
    rep = st.replay(st.movement_events(ev.filter("event_type='signup'"), ev.filter("event_type='purchase'"),
                                       "user_id", "q"))
    a = sorted(tuple(r) for r in out.collect())
    b = sorted(tuple(r) for r in rep.collect())
    assert a == b and len(a) > 0
    assert all(r[7] >= 0 for r in a)          # stock never negative
    assert any(not r[5] for r in a)           # some sales were rejected
