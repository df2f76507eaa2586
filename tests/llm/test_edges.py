"""Every operator on null ids and texts, empty and long texts, repeated rows, empty tables and extra columns with clashing names."""

import pytest
import public_tokenizers as P

from sievework.llm import bpe, chat, exact, leaks, quality, simhash, substrings, token_counts, urls, warc
from sievework.llm.common import new_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
SCHEMA = "doc_id long, text string, digest string, fp long, key string, block int, component_id string, n long, gone_id string, gone_digest string, id string, node string"
ROWS = [
    (1, WORDS), (2, WORDS), (2, WORDS), (3, None), (None, WORDS + " more"), (None, None), (4, ""), (5, " \t\n "), (6, "word"), (7, (WORDS + " ") * 3000), (8, "éñ 日本 <|endoftext|> 'll \u00a0 x"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "d", 1, "k", 2, "c", 3, "g", "h", "i", "o") for i, t in rows], SCHEMA)


def labels(spark, rows=((1, 1), (2, 0), (6, 1), (7, 0), (None, 1), (3, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def benchmark(spark, rows=((1, WORDS), (None, WORDS), (2, None), (3, "short one"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "exact": lambda s, d: exact.exact_duplicates(d),
    "keep_distinct": lambda s, d: exact.keep_distinct(d),
    "substrings": lambda s, d: substrings.dedup_substrings(d),
    "leaks": lambda s, d: leaks.find_leaks(d, benchmark(s)),
    "without_leaks": lambda s, d: leaks.without_leaks(d, benchmark(s)),
    "quality": lambda s, d: quality.score_documents(d, quality.fit(d, labels(s))),
    "keep_good": lambda s, d: quality.keep_good(d, quality.fit(d, labels(s))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "similar": lambda s, d: simhash.one_of_each(d),
    "bpe": lambda s, d: bpe.encode_decode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "tokens": lambda s, d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json"), new_path(s, "cache")),
}
#: Rows that each gives for ROWS.
EXPECTED = {"exact": 11, "substrings": 11, "quality": 11, "simhash": 11, "bpe": 11, "tokens": 11}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    rows = OPERATORS[name](spark, docs(spark)).collect()
    if name in EXPECTED:
        assert len(rows) == EXPECTED[name]
    assert sorted(OPERATORS[name](spark, docs(spark)).columns) == sorted(rows[0].asDict())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null(spark, name):
    OPERATORS[name](spark, docs(spark, [(None, None), (None, None)])).collect()


def test_edge_values(spark):
    by = lambda df, c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=str)
    e = by(exact.exact_duplicates(docs(spark)), ["doc_id", "keep_id", "group_size", "kept"])
    assert (1, 2, 3, False) in e and sorted(x[3] for x in e if x[0] == 2) == [False, True]
    assert (4, 4, 3, True) in e and (3, 4, 3, False) in e and (None, 4, 3, False) in e
    kept = by(exact.keep_distinct(docs(spark)), ["doc_id", "text"])
    assert len(kept) == len({t for _, t in kept}) == len({t or "" for _, t in ROWS}) and (2, WORDS) in kept and (1, WORDS) not in kept
    s = {r["doc_id"]: r for r in substrings.dedup_substrings(docs(spark)).collect()}
    assert s[2]["n_removed"] == 20 and s[2]["kept_text"] == "" and s[1]["n_removed"] == 0 and s[7]["n_removed"] >= 20 and s[3]["n_words"] == 0
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs(spark), benchmark(spark)).collect()}
    assert found == {(d, i) for d in (1, 2, 7, None) for i in (1, None)}
    assert {r["doc_id"] for r in leaks.without_leaks(docs(spark), benchmark(spark)).collect()} == {3, 4, 5, 6, 8, None}
    n = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark)).collect()}
    assert n[3]["fp"] == n[4]["fp"] == n[5]["fp"] == 0 and n[5]["component_id"] == 3
    assert n[2]["component_id"] == 1
    scores = [r["score"] for r in quality.score_documents(docs(spark), quality.fit(docs(spark), labels(spark))).collect()]
    assert all(0 <= x <= 1 for x in scores)


def test_edge_pages(spark, tmp_path):
    rows = [(1, "http://A.com/x", "p" * 200), (2, None, "p" * 200), (2, "no scheme", "p" * 200), (None, "http://a\r\nb/", "p" * 200), (4, "", None), (5, "", ""), (6, "x://", "q" * 99), (7, "x://y", "q" * 99), (8, "u://v", "é" * 50), (9, "u://v", "é" * 50)]
    pages = spark.createDataFrame([(i, u, h, "d", "p") for i, u, h in rows], "page_id long, url string, html string, digest string, payload string")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    got = sorted(((r["record_id"], r["type"], r["refers_to"], len(r["payload"])) for r in warc.read_records(spark, f"file://{tmp_path}/a").collect()), key=str)
    assert got == sorted([("1", "response", None, 200), ("2", "revisit", "1", 200), ("2", "revisit", "1", 200), (None, "revisit", "1", 200), ("4", "response", None, 0), ("5", "response", None, 0), ("6", "response", None, 99), ("7", "response", None, 99), ("8", "response", None, 100), ("9", "revisit", "8", 100)], key=str)
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == 4
    for r in warc.read_records(spark, f"file://{tmp_path}/a").collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert body == (b"" if r["type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n"
        assert f"Content-Length: {len(body) - 4}".encode() in head and head.startswith(b"WARC/1.1\r\n")
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_records(spark, f"file://{tmp_path}/b").count() == 0
    model = urls.fit_classes(pages, urls.fit_words(pages), [("block", "a.com", "/")])
    judged = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, model, [("block", "a.com", "/")]).collect()}
    assert (1, "a.com", "/x", "a.com/", "block") in judged and (2, "", "", None, "block") in judged and len(judged) == 9
    none = pages.limit(0)
    assert urls.judge_urls(none, urls.fit_classes(none, urls.fit_words(none), []), []).count() == 0


def test_edge_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (2, 5, "assistant", ""), (2, 1, "role: x\n", "</turn>\n### User: "), (3, 0, "User", "x")]
    turns = spark.createDataFrame([(*r, "f", "s") for r in rows], "conv_id long, turn long, role string, text string, formatted string, segments string")
    read = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert all(r["round_trip"] for r in read.values())
    assert [(t["role"], t["text"]) for t in read[1]["turns"]] == [("", ""), ("user", "a"), ("user", "a")]
    assert [(t["role"], t["text"]) for t in read[2]["turns"]] == [("role: x\n", "</turn>\n### User: "), ("assistant", "")]
    assert read[None]["loss_text"] == "b" and read[3]["loss_text"] == ""
    assert chat.format_chats(turns.limit(0)).count() == 0
    assert not {"plain_ok", "head"} & set(chat.format_chats(turns).columns)


def test_pipeline_edges(spark, tmp_path):
    """The five stages as a pipeline: nulls, repeated rows, a very long text, clashing columns; and each table empty in turn."""
    import corpus_pipeline

    def run(name, d, la, b):
        path = f"{tmp_path}/{name}"
        for table, df in (("documents", d), ("labels", la), ("benchmark", b)):
            df.write.parquet(f"file://{path}/{table}.parquet")
        return corpus_pipeline.run(spark, f"file://{path}").collect()

    d, la, b = docs(spark), labels(spark), benchmark(spark)
    passage = benchmark(spark, ((1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),))
    # without labels all stay in the first stage
    kept = run("a", d, la.limit(0), passage)
    # of the three texts of the twenty words, which are alike, the one with the null id; of those without words the smallest id
    assert {r["doc_id"] for r in kept} == {None, 4, 6, 8} and len(kept) == 4
    assert len(run("b", d, la, b.limit(0))) <= 4
    assert run("c", d.limit(0), la, b) == []
    assert len(run("d", d, la.limit(0), b)) < len(kept)  # those with the passage go


def test_very_long_chat_and_url(spark):
    long = "### </turn> x " * 20000
    read = chat.read_chats(chat.format_chats(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string"))).first()
    assert read["round_trip"] and read["loss_text"] == long
    pages = spark.createDataFrame([(1, "http://" + "ab" * 3000 + ".com/" + "x/" * 5000, "ab " * 50000)], "page_id long, url string, html string")
    model = urls.fit_classes(pages, urls.fit_words(pages), [])
    assert urls.judge_urls(pages, model, []).first()["verdict"] == "allow"
