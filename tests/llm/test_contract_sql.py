"""Queries on small hostile tables against SQL that states their contracts plainly."""

import random

import duckdb
import pytest

from textloom.llm import chat, ngram_join, url_filter

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents that share 5-word shingles, compared pair by pair, and what is reached by their links.
LINKS = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = d.doc_id"""


def both(spark, folder, query, sql, **tables):
    """The query's rows and the SQL's over ``tables`` (schema, rows), sorted, in the SQL's columns."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    key = lambda row: tuple(map(str, row))
    return sorted(map(tuple, query(spark, str(folder)).select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)


def talks(seed):
    rng = random.Random(seed)
    bits = ["word ", "\\", "<", "[", ">", "\\a", "</turn>", "<turn user 0 L>", "</s>[INST]", "é\n", "\U0001f600", "x" * 700, ""]
    rows = []
    for conv in range(30):
        for turn in range(rng.choice([1, 2, 5, 40])):
            role = rng.choice(["user", "assistant", "assistant", "a b>\\[<", None]) if turn or rng.random() < 0.5 else "system"
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
            rows += [(conv, rng.choice([turn, turn, None]) if turn else -1, role, text, "conv")] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("rows", [[], talks(1), talks(2)], ids=["empty", "one", "two"])
def test_chat_windows(spark, tmp_path, rows):
    got, want = both(spark, tmp_path, chat.op7_budgeted_chat_windows, chat.SQL, conversations=("conv_id long, turn long, role string, text string, e string", rows))
    assert got == want and len(got) == len({r[0] for r in rows}) + 1


def urls(seed):
    rng = random.Random(seed)
    hosts = ["a.com", "B.a.com", "example.com", "www.Example.COM", "net", "x.net", "org", "notorg", "x.org.", "h", "a..b", "", "1.2.3.4:80", "bad.io", "bad.io", "w.bad.io"]
    paths = ["", "/", "/en/", "/en/7?x", "/de/8", "/de/#f", "/es/x", "?en/", "#", "/EN/"]
    pages = [(i // 2 if i < 20 else i, rng.choice(["http://", "://", "s://", ""]) + rng.choice(hosts) + rng.choice(paths), "h", 1) for i in range(600)]
    pages += [(9000, None, None, None), (9001, "http://a.com/en/://b", "h", 1), (None, "http://x.net/de/", "h", 1)]
    good = {i: 0 if "bad" in (u or "") and rng.random() < 0.95 else 1 for i, u, *_ in pages}
    labels = [(i, rng.choice([g, g, g, g, None]), 0, "u") for i, g in good.items() if rng.random() < 0.7]
    return pages, labels + labels[:20]


@pytest.mark.parametrize("data", [([], []), (urls(1)[0], []), urls(1), urls(2)], ids=["empty", "no labels", "one", "two"])
def test_host_reputation(spark, tmp_path, data):
    pages, labels = data
    got, want = both(
        spark, tmp_path, url_filter.op3_host_reputation, url_filter.SQL,
        pages=("page_id long, url string, html string, host int", pages), labels=("doc_id long, quality int, toxic int, url string", labels),
    )
    assert got == want and len(got) == len(pages)
    if labels:
        blocked = {r[1] for r in got if r[3] is None and r[4] == "block"}
        assert "bad.io" in blocked and "h" not in blocked


def copies(seed):
    rng = random.Random(seed)
    base = [[rng.choice(["One", "two", "THREE", "é", "É", "x\u00a0y", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([3, 5, 12, 60, 300]))] for _ in range(25)]
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "a  b\tc\nd", "a b c"]
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            words[rng.randrange(len(words))] = rng.choice(["new", "two"])
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    return [(i, t, 7, "k", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [[], copies(1), copies(2)], ids=["empty", "one", "two"])
def test_join_components(spark, tmp_path, rows):
    schema = "doc_id long, text string, n int, text_key string, class_id int"
    got, want = both(spark, tmp_path, ngram_join.op5_ngram_jaccard_join, LINKS, documents=(schema, rows))
    assert got == want and len(got) == len(rows)
