"""Unified assets against union-find, and golden records by source order."""

import random

from marlstone.operators import unify

SCHEMA = "source string, id string, symbol string, contract string, name string, price double"
ORDER = ["a", "b", "c"]


def plain(rows):
    """(source, id) -> (asset, matched_by)."""
    rank = lambda s: ORDER.index(s) + 1 if s in ORDER else len(ORDER) + 1
    norm = lambda c: None if c is None or not c.strip() else c.strip().lower() if c.strip()[:2].lower() == "0x" else c.strip()
    key = lambda r: (r[0], r[1])
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    contract_rows = {key(r) for r in rows if norm(r[3])}
    for r in rows:
        find(("row", *key(r)))
        if norm(r[3]):
            root[find(("row", *key(r)))] = find(("contract", norm(r[3])))
    symbols = {}
    for r in rows:
        if key(r) in contract_rows and r[2] and r[2].strip():
            symbols.setdefault(r[2].strip().upper(), set()).add(find(("row", *key(r))))
    how, seen = {}, {key(r): r for r in rows if key(r) not in contract_rows}
    for k, r in seen.items():
        s = (r[2] or "").strip().upper()
        owners = symbols.get(s, set()) if s else set()
        how[k] = "ambiguous" if len(owners) > 1 else "symbol"
        if len(owners) == 1:
            root[find(("row", *k))] = next(iter(owners))
        elif not owners and s:
            root[find(("row", *k))] = find(("symbol", s))
    groups = {}
    for r in rows:
        groups.setdefault(find(("row", *key(r))), set()).add(key(r))
    out = {}
    for own in groups.values():
        first = min(own, key=lambda k: (rank(k[0]), k[0], k[1]))
        for k in own:
            by = "contract" if k in contract_rows else how[k]
            out[k] = (f"{first[0]}:{first[1]}", "alone" if len(own) == 1 and by != "ambiguous" else by)
    return out


def test_against_union_find(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        c = rng.choice([None, "", f"0xAB{rng.randrange(80)}", f"0Xab{rng.randrange(80)}", f"So{rng.randrange(40)}", f"so{rng.randrange(40)}"])
        rows.append((rng.choice(["a", "b", "c", "other"]), str(rng.randrange(150)), rng.choice([None, "", f"s{rng.randrange(60)}", f" S{rng.randrange(60)}"]), c, f"n{i}", float(i)))
    # A row's symbol is one: repeated ids take the first one's.
    symbol = {}
    rows = [(s, i, symbol.setdefault((s, i), y), c, n, p) for s, i, y, c, n, p in rows]
    df = spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(4)
    found = {(r.source, r.id): (r.asset, r.matched_by) for r in unify.members(df, ORDER).collect()}
    assert found == plain(rows)


def test_chain_of_contracts_and_golden(spark):
    rows = [
        ("b", "1", "X", "0xA", None, 5.0), ("c", "9", "Y", "0xa", "nine", 1.0), ("c", "9", "Y", "0xB", "nine", 1.0), ("a", "7", "Z", "0xb", None, None),
        ("b", "2", "q", None, "two", 2.0), ("c", "3", "Q", None, "three", None), ("a", "8", "x", None, "eight", 3.0), ("c", "4", None, None, "four", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = unify.members(df, ORDER)
    assert {(r.source, r.id): r.asset for r in found.collect()} == {("b", "1"): "a:7", ("c", "9"): "a:7", ("a", "7"): "a:7", ("a", "8"): "a:7", ("b", "2"): "b:2", ("c", "3"): "b:2", ("c", "4"): "c:4"}
    gold = {r.asset: (r.name, r.name_source, r.price, r.price_source) for r in unify.golden(df, found, ORDER, ["name", "price"]).collect()}
    assert gold == {"a:7": ("eight", "a", 3.0, "a"), "b:2": ("two", "b", 2.0, "b"), "c:4": ("four", "c", None, None)}


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert unify.members(df, ORDER).count() == 0
