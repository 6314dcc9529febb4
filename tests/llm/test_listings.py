"""Listings of one product, in other words and units; siblings; slips; edge cases."""

from gristmill.llm import listings as L

SCHEMA = "id string, title string, about string, w string, n int, props string"
NAMES = ["bakuro", "tilume", "fosane", "gridex", "molunta", "sarivo", "penduka", "valtero"]


def corpus(spark):
    rows = []

    def add(i, title, about=None):
        rows.append((i, title, about, "w", 1, "p"))

    add("a1", "ACME Bakuro 120 USB-C Cable 1 m 33W Blue Best Seller")
    add("a2", "Acme, bakuro-120, type C cable, BLU, 100 cm, 33 Watt", "Suits rooms up to 13 m²\nAlso works next to the Acme Bakuro 300")
    add("a3", "3.3 ft Type C cord NEW 2024 Bakuro No. 120", "Brand: Acme | Colour: Blue | Power 33 watts")
    add("a4", "Acme Bakruo Model 120 USB-C Cable 1m 33 W blue")
    add("a5", "USB-C Cable 33 W Blue", "Model name Bakuro 120; Made by Acme; Length: 1 m. No. 9 in our workshop test")
    add("b1", "ACME Bakuro 120 USB-C Cable 2 m 33W Blue")
    add("c1", "ACME Bakuro 300 USB-C Cable 1 m 33W Blue")
    add("d1", "ACME Bakuro 120 USB-C Cable 1 m 33W Red")
    for k, name in enumerate(NAMES[1:]):
        for j in range(3):
            add(f"{name}{j}", f"Zeta {name} {200 + k} Desk Lamp {10 + 5 * k} W White" + (" NEW 2024" if j else ""))
    return spark.createDataFrame(rows, SCHEMA)


def test_groups(spark):
    groups = {}
    for r in L.group_listings(corpus(spark), "id", "title", "about").collect():
        groups.setdefault(r.group_id, set()).add(r.id)
    sets = set(map(frozenset, groups.values()))
    assert frozenset({"a1", "a2", "a3", "a4", "a5"}) in sets
    assert {frozenset({x}) for x in ("b1", "c1", "d1")} <= sets
    assert {frozenset({f"{n}{j}" for j in range(3)}) for n in NAMES[1:]} <= sets


def test_pairs_are_ordered_and_once(spark):
    g = L.group_listings(corpus(spark), "id", "title", "about")
    pairs = [(r.id_a, r.id_b) for r in L.same_product_pairs(g, "id").collect()]
    assert all(a < b for a, b in pairs) and len(pairs) == len(set(pairs)) == 10 + 3 * len(NAMES[1:])


def test_two_brands_of_one_name(spark):
    rows = [
        ("1", "Acme Bakuro 120 Lamp 5 W", "Brand: Acme"), ("2", "Acme Bakuro 120 Lamp 5 W", None), ("3", "Zeta Bakuro 120 Lamp 5 W", "Zeta product"),
        ("4", "Zeta Bakuro-120 lamp 5W", ""),
    ]
    df = spark.createDataFrame(rows, "id string, t string, d string")
    pairs = {(r.id_a, r.id_b) for r in L.same_product_pairs(L.group_listings(df, "id", "t", "d"), "id").collect()}
    assert pairs == {("1", "2"), ("3", "4")}


def test_properties():
    read = lambda t, d=None: L.read_listing(t, d)[0]
    assert read("1.5 L bottle") == read("1500ml bottle") == read("150cl bottle") == "volume=1500.0"
    assert read('TV 32"') == read("TV 81 cm") == read("32-inch TV") == "length=810.0"
    assert read("Drive 64G") == read("64 GB drive") == "capacity=64.0" and read("scale 400 g") == "weight=400.0"
    assert read("1TB card") == read("1024 GB card") and read("20,000 mAh") == read("20 Ah") == "battery=20000.0"
    assert read("Pack of 3") == read("3-pack") == read("set of 3") == read("3 pcs") and read("single") == "pack=1.0"
    assert read("x", "Suits rooms up to 13 m² | Keeps working down to -3 °C | Ships with 16 spare clips") == ""
    assert read("", None) == "" and L.read_listing(None, None) == ("", "", [], [])


def test_slips():
    assert L.slips("bakuro", "bakruo", 2) == 1 and L.slips("bakuro", "bakuro", 2) == 0
    assert L.slips("bakuro", "bkuro", 2) == 1 and L.slips("abc", "xyz", 2) == 3 and L.slips("a", "abcdef", 2) == 3
    assert L.merge_names(["abcdef", "abcdfe", "zzzzzz"]) == {"abcdef": "abcdef", "abcdfe": "abcdef", "zzzzzz": "zzzzzz"}


def test_many_names_of_one_number_are_linked_across_tasks(spark):
    rows = [(str(i), f"Acme {w} 120 Lamp 5 W", None) for i, w in enumerate(["bakuro", "bakruo", "bakkuro", "bakkurro", "tilume", "tilme", "gridex"])]
    df = spark.createDataFrame(rows, "id string, t string, d string")

    def sets(**how):
        groups = {}
        for r in L.group_listings(df, "id", "t", "d", **how).collect():
            groups.setdefault(r.group_id, set()).add(r.id)
        return sorted(map(sorted, groups.values()))

    assert sets(names_in_task=1) == sets() == [["0", "1", "2", "3"], ["4", "5"], ["6"]]


def test_edges(spark):
    rows = [("1", None, None, "", 1, ""), ("2", "", "", "", 1, ""), ("3", "x" * 100_000, None, "", 1, ""), ("4", "only words here", "", None, None, None), ("4", "only words here", "", "q", 9, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.group_listings(df, "id", "title", "about").collect()
    assert sorted(r.id for r in got) == ["1", "2", "3", "4"] and len({r.group_id for r in got}) == 4
    assert L.group_listings(df.limit(0), "id", "title", "about").count() == 0


def test_noise_in_the_title_gives_way_to_a_model_in_a_sentence(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARED_ROWS", 8)
    rows = [("x1", "Best Lamp 5 W White NEW 2024", "You get the bakuro 120 at its best."), ("x2", "Bakuro 120 Lamp 5 W White", None)]
    rows += [(f"{n}{j}", f"{n} {200 + k} Lamp 5 W White" + " NEW 2024" * (j < 2), "Also next to the bakuro 120 at home.") for k, n in enumerate(NAMES[1:]) for j in range(3)]
    df = spark.createDataFrame(rows, "id string, t string, d string")
    pairs = {(r.id_a, r.id_b) for r in L.same_product_pairs(L.group_listings(df, "id", "t", "d"), "id").collect()}
    assert ("x1", "x2") in pairs and len(pairs) == 1 + 3 * len(NAMES[1:])


def test_listings_without_a_number(spark, monkeypatch):
    rows = [
        ("a", "Zeta Bakuro Reading Lamp White", None), ("b", "Zeta Bakuro Reading Lamp White", None), ("c", "White lamp bakuro Zeta", None),
        ("d", "Zeta Bakuro Reading Lamp Red", None), ("e", "Zeta Fosane Reading Lamp White", None), ("f", "Sofa", None), ("g", "sofa", ""), ("h", None, None), ("i", None, None),
    ]
    find = lambda rows: {(r.id_a, r.id_b) for r in L.same_product_pairs(L.group_listings(spark.createDataFrame(rows, "id string, t string, d string"), "id", "t", "d"), "id").collect()}
    got = find(rows)
    assert {("a", "b"), ("f", "g")} <= got and got <= {("a", "b"), ("a", "c"), ("b", "c"), ("f", "g")}
    # Words of very many listings: equal titles only.
    monkeypatch.setattr(L, "SHARED_ROWS", 1)
    assert find([("a", "Desk Lamp", None), ("b", "desk lamp", None), ("c", "Small desk lamp", None), ("d", "Desk lamp sale", None)]) == {("a", "b")}


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "id string, t string, d string")
    return {(r.id_a, r.id_b) for r in L.same_product_pairs(L.group_listings(df, "id", "t", "d"), "id").collect()}


def test_no_digit_other_colours_and_more_properties(spark):
    rows = [
        ("a", "Acme Breeze Ceiling Fan White", None), ("b", "ACME Breeze ceiling fan, white", None),
        ("c", "Acme Breeze 100 Fan 50 W maroon", None), ("d", "Acme Breeze 100 Fan 50 W violet", None),
        ("e", "Acme Gustora 300 Fan 50 W", None), ("f", "Acme Gustora 300 Fan 50 W", "Weight: 3 kg"), ("g", "Acme Gustora 300 Fan 0.05 kW", "Weight: 3 kg | Colour: red"),
        ("h", "Acme Windler 400 Fan 50 W", None), ("i", "Acme Windler 400 Fan 50 W red", None), ("j", "Acme Windler 400 Fan 50 W blue", None),
    ]
    # One that states less joins the others only where those agree.
    assert pairs_of(spark, rows) == {("a", "b"), ("e", "f"), ("e", "g"), ("f", "g")}


def test_group_ids_have_128_bits(spark):
    rows = [("a", "Acme Breeze 100", None), ("b", None, None)]
    assert {len(r.group_id) for r in L.group_listings(spark.createDataFrame(rows, "id string, t string, d string"), "id", "t", "d").collect()} == {32}


def test_a_chain_of_slips(spark):
    names = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx", "abuvwzyx", "atuvwzyx"]
    rows = [(str(i), f"Acme {w} 120 Lamp 5 W", None) for i, w in enumerate(names)] + [("9", "Acme qqqqqqqq 120 Lamp 5 W", None)]
    df = spark.createDataFrame(rows, "id string, t string, d string")
    assert len(L.same_product_pairs(L.group_listings(df, "id", "t", "d", names_in_task=1), "id").collect()) == len(names) * (len(names) - 1) // 2


def test_no_exploded_table_is_broadcast(spark, monkeypatch):
    # Spark sized the combinations like the listings that they come from and sent all of them to the driver.
    listings = spark.range(20).selectExpr("id AS row", "array('bakuro', string(id)) AS tokens", "2 AS owned", f"array({1 << 15 | 10_000 << 1 | 1}L) AS codes")
    joins = lambda: L._best_combinations(listings, 20)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    assert joins() == 2  # the counts of tokens, whose number is known
    monkeypatch.setattr(L, "BROADCAST_TOKENS", 0)
    assert joins() == 0
