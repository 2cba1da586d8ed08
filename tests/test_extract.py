"""Tables, sections and slugs out of odd pages."""

from pyspark.sql import functions as F

from marlstone.operators import extract

HOLDERS = "<table><tr><th>#</th><th>Holder</th><th>Balance</th><th>Share</th></tr>"
PAGES = {
    1: f"<h1>x</h1>{HOLDERS}<tr><td>1</td><td><a>0xABc</a></td><td>1,234.5</td><td>12.5%</td></tr><tr><td>2<td>So1 <td>7<td></table>",
    2: None,
    3: "<p>no table</p>",
    4: "<table><tr><th>Name</th><th>Price</th></tr><tr><td>a</td><td>1</td></tr></table>",
    5: f"{HOLDERS}</table>",
    6: "<TABLE class='t'\n><TR><TD>Quantity</TD><TD>Address</TD></TR><TR><TD>$5</TD><TD> 0xFF </TD></TR><tr><td>none</td><td>0xEE</td></tr><tr><td>3</td><td>two words</td></tr></TABLE>",
    7: f"<!-- {HOLDERS}<tr><td>1<td>0x1<td>1<td>1</table> --><script>'{HOLDERS}<tr><td>1<td>0x2<td>1<td>1</table>'</script>",
    8: f"{HOLDERS}<tr><td>9<td>0x9<td>9<td>9</table><table></table>" * 2,
    9: "",
}


def pages(spark, rows):
    return spark.createDataFrame(list(rows.items()), "page_id long, html string")


def test_holder_rows(spark):
    rows, unread = extract.holder_rows(pages(spark, PAGES))
    got = sorted((r.page_id, r["rank"], r.address, r.quantity, r.share) for r in rows.collect())
    assert got == sorted([(1, 1, "0xabc", 1234.5, 0.125), (1, 2, "So1", 7.0, None), (6, 1, "0xff", 5.0, None), (8, 9, "0x9", 9.0, 0.09), (8, 9, "0x9", 9.0, 0.09)], key=lambda r: r[:2])
    assert {r.page_id: r.reason for r in unread.collect()} == {2: "no page", 3: "no table", 4: "no holder table", 5: "no row", 7: "no table", 9: "no table"}


def test_long_page(spark):
    html = HOLDERS + "".join(f"<tr><td>{i}</td><td>0x{i}</td><td>{i}</td><td>1</td></tr>" for i in range(5000)) + "</table>" + "<p>" * 100_000
    rows, _ = extract.holder_rows(pages(spark, {1: html}))
    assert rows.count() == 5000 and rows.agg(F.sum("quantity")).first()[0] == sum(range(5000))


def test_sections(spark):
    rows = {
        1: "a<h1>About us</h1>one<b>two</b><h2>Vesting</h2>x &amp; y<h3>Other</h3>lost<h4>Token unlock dates</h4>more<h2>Revenue</h2>  <h2>FDV</h2>9",
        2: "no heading", 3: None, 4: "<h2>Unlocks and fees</h2>first wins<h2>fees",
    }
    got = {(r.page_id, r.section): r.text for r in extract.sections(pages(spark, rows)).collect()}
    assert got == {(1, "overview"): "one two", (1, "unlocks"): "x & y\nmore", (1, "valuation"): "9", (4, "unlocks"): "first wins"}


def test_slugs(spark):
    df = spark.createDataFrame([(1, "uni_swap", "UNI", "Uniswap Protocol"), (2, None, None, None), (3, "btc", "BTC", "Bitcoin"), (4, None, "A B", "--"), (5, "", None, "Só Coin")], "asset_id long, source_id string, symbol string, name string")
    got = {}
    for r in sorted(extract.slugs(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.asset_id, []).append((r.slug, r.made_of))
    assert got == {
        1: [("uni-swap", "source_id"), ("uni", "symbol"), ("uniswap-protocol", "name"), ("uniswap", "short name"), ("uni-uniswap-protocol", "symbol and name")],
        3: [("btc", "source_id"), ("bitcoin", "name"), ("btc-bitcoin", "symbol and name")], 4: [("a-b", "symbol")], 5: [("só-coin", "name"), ("só", "short name")],
    }
    kept = spark.createDataFrame([("uniswap", 70), ("uniswap-protocol", 71), ("uniswap-protocol", 69), ("btc-bitcoin", 5)], "slug string, page_id long")
    found, missing = extract.matched_slugs(df, kept)
    assert {r.asset_id: (r.slug, r.page_id) for r in found.collect()} == {1: ("uniswap-protocol", 69), 3: ("btc-bitcoin", 5)}
    assert sorted(r.asset_id for r in missing.collect()) == [2, 4, 5]
