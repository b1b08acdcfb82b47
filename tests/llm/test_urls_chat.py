import duckdb
import pytest

from quire.llm import chat, queries, urls


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order([tuple(r[c] for c in columns) for r in found.collect()]) == order([tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()])


URLS = ["http://A.Example.NET/en/x?q", "https://net", "https://net/", "x.net/en/", None, "", "ftp://www.example.com/de/#f", "http://example.com?de/", "http://example.org/fr/a", "http://myexample.net/en/", "http://notnet/", "a://b://c/d", "http://www.x.org/p.html", "http://x.org/p/", "http://m.x.org/p?z"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("x.org/p",), ("x.org/p",), (None,)], "canonical string")
    for broadcast in (64 << 20, 0):
        found = {r.page_id: r for r in urls.judge(pages, listed, broadcast_bytes=broadcast).collect()}
        assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in range(len(URLS))] == [
            ("a.example.net", "/en/x", "example.net/en/", "allow"),
            ("net", "", None, "allow"),
            ("net", "/", "net/", "block"),
            ("", "", None, "allow"),
            ("", "", None, "allow"),
            ("", "", None, "allow"),
            ("www.example.com", "/de/", "example.com/de/", "block"),
            ("example.com", "", None, "allow"),
            ("example.org", "/fr/a", "org/fr/", "allow"),
            ("myexample.net", "/en/", "net/", "block"),
            ("notnet", "/", None, "allow"),
            ("b:", "//c/d", None, "allow"),
            ("www.x.org", "/p.html", None, "block"),
            ("x.org", "/p/", None, "block"),
            ("m.x.org", "/p", None, "block"),
        ]
    none = urls.judge(pages, listed.where("false"))
    assert none.where("listed").count() == 0 and none.count() == len(URLS)
    assert urls.judge(pages.where("false"), listed).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as canonical")
    pages = spark.range(20000).selectExpr("id as page_id", "concat('http://k', id) as url")
    found = urls.judge(pages, keys, rules=[])
    assert found.where("listed").count() == 5000 and found.where("listed and not possible").count() == 0
    assert found.where("possible and not listed").count() < 0.02 * 15000


def turn(k, role, text):
    return (k, role, text)


def test_prefixes(spark):
    a, b, c = turn(0, "user", "hi"), turn(1, "assistant", "yes"), turn(1, "assistant", "no")
    more = turn(2, "user", "ok")
    rows = [(1, [a, b, more], [a, c]), (2, [a, b], [a, b]), (3, [b], [c]), (4, None, [a]), (5, [], []), (6, [turn(0, None, None)], [turn(0, "", "")]), (7, [a, b], [a])]
    pairs = spark.createDataFrame(rows, f"pair_id long, chosen {chat.TURNS}, rejected {chat.TURNS}")
    pairs = pairs.withColumn("prompt", chat.F.lit("clash"))
    found = {r.pair_id: r for r in chat.format_pairs(pairs).collect()}
    assert found[1].prompt == "<|user|>\nhi\n" and found[1].chosen == "<|assistant|>\nyes\n<|user|>\nok\n" and found[1].rejected == "<|assistant|>\nno\n"
    for r in found.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[s.start : s.start + s.length].endswith("\n") and "<|" not in text[s.start : s.start + s.length] for s in spans)
    assert [found[1].chosen[s.start : s.start + s.length] for s in found[1].chosen_spans] == ["yes\n"]
    assert (found[2].n_prompt, found[2].chosen, found[2].rejected) == (2, "", "")
    assert found[3].n_prompt == 0 and found[4].prompt == "" and found[4].rejected != "" and found[5].prompt == "" and found[7].rejected == ""


def test_query_on_odd_rows(spark, tmp_path):
    """Null ids, numbers, roles and texts, repeated rows, shared beginnings and extra columns: the same as in SQL, and by hand."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    rows += [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (2, 3, "assistant", "e"), (2, 4, "user", "f")]
    rows += [(4, 0, None, "x"), (4, 1, "assistant", None), (4, 1, "assistant", None), (5, None, "user", "n"), (5, 0, "assistant", "m"), (None, 0, "user", "a"), (None, None, "assistant", "q")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, prompt string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.execute(chat.OP8_SQL)
    names = [d[0] for d in rel.description]
    found = chat.op8_preferences(spark, str(tmp_path)).collect()
    assert sorted(str({n: r[n] for n in names}) for r in found) == sorted(str(dict(zip(names, x))) for x in rel.fetchall())
    by = {r.pair_id: r for r in found}
    assert {k: r.n_prompt for k, r in by.items()} == {1: 3, 2: 2, 4: 1, 5: 1, None: 1}
    assert by[1].chosen == "<|assistant|>\nd\n" and by[1].rejected == "<|assistant|>\ne\n<|user|>\nf\n"
    assert by[5].prompt == "<|user|>\nn\n" and by[5].rejected == ""


def test_hot_urls(spark, monkeypatch):
    """A URL of most pages is listed or not alike, whether the list goes by broadcast or not."""
    pages = spark.range(6000).selectExpr("id as page_id", "case when id % 3 > 0 then 'http://hot/x.html' else concat('http://k', id) end as url")
    pages = pages.unionByName(pages.where("page_id < 5")).unionByName(spark.createDataFrame([(9000, "http://" + "long" * 20000), (9001, None)], "page_id long, url string"))
    keys = spark.createDataFrame([("hot/x",), ("k3",), ("long" * 20000,)], "canonical string")
    want = sorted(map(tuple, urls.judge(pages, keys).collect()))
    monkeypatch.setattr(urls, "FEW", 0)
    assert sorted(map(tuple, urls.judge(pages, keys, broadcast_bytes=0).collect())) == want
    assert len(want) == 6007 and sum(r[-1] for r in want) == 4003 + 2 + 1  # of the hot URL, of k3 and of the long one


def test_odd_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, 1, None, None, "x"), (2, 0, "user", "b", "x")], "conv_id long, turn int, role string, text string, reply string")
    found = chat.format_pairs(chat.crossed(chat.conversations(rows))).collect()
    assert len(found) == 2
    assert chat.conversations(rows.where("false")).count() == 0
