"""Operators on small tables against plain Python, and edge cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import rules, text
from passagework.operators import chunking, contract, metrics, retrieval
from passagework.sources import files, sinks
from passagework.streaming import feeds


def pack(lines, most=1400):
    parts, buffer, size = [], [], 0
    for i, line in enumerate(lines):
        if buffer and size + len(line) > most:
            parts.append((buffer[0], buffer[-1], size))
            buffer = buffer[-1:]
            size = len(lines[buffer[0]])
        buffer.append(i)
        size += len(line)
    return parts + [(buffer[0], buffer[-1], size)] if buffer else parts


def test_packing_against_python(spark):
    rng = random.Random(1)
    texts = {i: [rng.choice("abc") * rng.choice([1, 50, 300, 1399, 1400, 2000]) for _ in range(rng.randint(1, 12))] for i in range(40)}
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()] + [(99, None), (98, "  \n ")], "doc_id int, text string")
    got = {}
    for r in chunking.packed(chunking.lines(docs)).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append((r.first, r["last"], r.chars))
    assert got == {i: pack(x) for i, x in texts.items()}


def test_sections_carry_over_and_merge(spark):
    rows = [(1, 0, "above"), (1, 1, "# A"), (1, 2, "x"), (1, 3, "# A"), (1, 4, "y"), (1, 5, "# B"), (1, 6, "# C"), (1, 7, "z"), (2, 0, "# only")]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    got = [(r.line, r.header, r.section) for r in chunking.sections(lines, F.col("line").startswith("#")).orderBy("doc_id", "line_no").collect()]
    assert got == [("above", None, 1), ("x", "# A", 2), ("y", "# A", 2), ("z", "# C", 3)]


def test_fractions_and_scripts(spark):
    rows = spark.createDataFrame([("2/6",), ("0/0",), ("1/0",), ("8/4",), ("7",), ("a/b",), ("12345678901/24691357802",)], "x string")
    assert [r[0] for r in rows.select(text.reduced(F.col("x"))).collect()] == ["1/3", "0/0", "1/0", "2/1", "7", "a/b", "1/2"]
    assert spark.createDataFrame([("",)], "x string").select(text.share(text.latin(F.col("x")), text.devanagari(F.col("x")))).first()[0] == 0.0


def test_prefix_guards(spark):
    rows = spark.createDataFrame([(1, "विभिन्न"), (2, "टैनग्राम"), (3, "भारत"), (4, "भिन्नों")], "id int, t string")
    got = {r.id: (list(r.tags), r.p.reason) for r in rows.select("id", rules.tags(F.col("t")).alias("tags"), rules.pre_check(F.col("t")).alias("p")).collect()}
    assert got[1][0] == [] and got[2][0] == ["geometry.tiling_patterns"] and got[3][0] == ["measurement.weight"] and got[3][1] == "too_short" and got[4] == (["fractions"], None)


def test_instructions_once_each(spark):
    row = spark.createDataFrame([(["too_long", "missing_part:rule", "missing_part:answer"],)], "c array<string>").select(contract.instructions(F.col("c"))).first()[0]
    assert row == "- fix too_long\n- fix missing_part"


def test_dense_paths_agree(spark, monkeypatch):
    rng = random.Random(2)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    q = spark.createDataFrame([(i, vector()) for i in range(5)], "qid long, qv array<float>")
    c = spark.createDataFrame([(i, vector()) for i in range(30)], "cid long, cv array<float>")
    one = {(r.qid, r.cid): round(r.dense, 5) for r in retrieval.dense(q, c).collect()}
    monkeypatch.setattr(retrieval, "QUESTIONS", 2)
    assert one == {(r.qid, r.cid): round(r.dense, 5) for r in retrieval.dense(q, c).collect()}
    assert len(one) == 150 and retrieval.dense(q.limit(0), c).count() == 0


def test_ttl_does_not_renew(spark):
    rows = spark.createDataFrame([("a", s) for s in (0, 3000, 3601, 7000, 7300)] + [(None, 1)], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    got = [int(r.at.timestamp()) for r in metrics.deduplicated(rows, "k", "at", 3600).orderBy("at").collect()]
    assert got == [0, 3601, 7300]


def test_round_robin(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(10)] + [(20, 7)], "id int, s int")
    assert [r.id for r in metrics.round_robin(rows, "s", "id", 6).collect()] == [0, 1, 2, 20, 3, 4]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"id": 1, "q": "a"}]')
    (tmp_path / "wrapped.json").write_text('{"questions": [{"id": 2, "q": "b"}, {"id": 3, "q": "c"}]}')
    assert [r.id for r in files.listed_or_wrapped(spark, str(tmp_path / "list.json"), "id int, q string").collect()] == [1]
    assert sorted(r.id for r in files.listed_or_wrapped(spark, str(tmp_path / "wrapped.json"), "id int, q string").collect()) == [2, 3]
    assert files.json_rows(spark, str(tmp_path / "list.json"), "id int, q string").count() == 1
    assert files.optional(spark, str(tmp_path / "none.parquet"), "id int").count() == 0
    (tmp_path / "w.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t300\t600\t150\t30\t96.5\t\"word\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t50\t \n")
    (word,) = files.ocr_words(spark, str(tmp_path / "w.tsv")).collect()
    assert (word.text, word.x0, word.x1, word.y0, word.conf, word.line) == ('"word', 72.0, 108.0, 144.0, 96, "1-1-1")
    (tmp_path / "env").write_text("# no\nA='1=2'\nB = x\n\nnothing\n")
    assert {r.key: r.value for r in files.settings(spark, str(tmp_path / "env"), {"B": "own"}).collect()} == {"A": "1=2", "B": "own"}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"%PDF" + b"x" * 20_000 + b"%%EOF")
    (tmp_path / "pdf/b.pdf").write_bytes(b"<html>" + b"x" * 20_000)
    assert sorted((r.path[-5:], r.complete) for r in files.whole_files(spark, str(tmp_path / "pdf")).collect()) == [("a.pdf", True), ("b.pdf", False)]
    manifest = spark.createDataFrame([("c1", 0, 5, 7, True), ("x", 0, 8, 9, False)], "code string, pdf_page_first int, book_page_start int, book_page_end int, in_retrieval_corpus boolean")
    assert [(r.page, r["at"]) for r in files.pages_of(manifest).orderBy("page").collect()] == [(5, 0), (6, 1), (7, 2)]
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    with pytest.raises(ValueError, match="2 x 2"):
        sinks.checked_unique(ids, "id")
    tried = spark.createDataFrame([("p", 1, 200), ("p", 2, 120), ("q", 1, 300), ("q", 2, 250)], "page string, ord int, size int")
    assert {r.page: r.ord for r in sinks.within_budget(tried, "page", "ord", "size", 130).collect()} == {"p": 2, "q": 2}
    sinks.write_texts(spark.createDataFrame([("m", 3, "t")], "method string, page int, text string"), str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).first()["page"] == 3
    names = spark.createDataFrame([("a.PDF",), ("b.py",)], "name string")
    assert [r.name for r in sinks.forbidden(names, "name").collect()] == ["a.PDF"]


def test_message_feed(spark, tmp_path):
    def body(*messages, receipts=()):
        return json.dumps({"entry": [{"changes": [{"value": {"messages": list(messages), "statuses": [{"id": r} for r in receipts]}}]}, {"changes": None}]})

    text_message = lambda i, t: {"id": i, "from": "9", "type": "text", "text": {"body": t}}
    rows = [(body(text_message("m1", "hello")), "2024-01-01 00:00:00"), (body(receipts=["m1"]), "2024-01-01 00:00:01"), (body(text_message("m1", "hello"), {"id": "m2", "from": "9", "type": "audio", "audio": {"id": "a"}}), "2024-01-01 00:00:02"), (body(text_message("m3", " ")), "2024-01-01 00:00:03"), ("{}", "2024-01-01 00:00:04")]
    spark.createDataFrame(rows, "body string, at string").select("body", F.col("at").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("body string, at timestamp").parquet(str(tmp_path / "feed"))
    found = feeds.finished(feeds.handled_once(feeds.messages(stream), "id", "at")).withColumn("way", feeds.route(F.col("type"), F.col("text")))
    assert sorted((r.id, r.way) for r in found.collect()) == [("m1", "answer"), ("m2", "voice_reply"), ("m3", "ask_again")]


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and rows.columns[:2] == ["qid", "refuse"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_terms_keep_vowel_signs(spark):
    from passagework.functions import text

    rows = spark.createDataFrame([("यह किताब 3/4 बच्चों की है, café 12",)], "t string")
    assert rows.select(text.terms(rows.t)).first()[0] == ["यह", "किताब", "3/4", "बच्चों", "की", "है", "café", "12"]


def test_running_ids_with_nulls_and_gaps(spark):
    from passagework.plans.records import running_ids

    keys = [None, 3, None, 9_000, 5, 4_096, -1, 123_456]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = sorted((r.rid, r.k) for r in running_ids(rows, "k").collect())
    assert got == list(enumerate([None, None, -1, 3, 5, 4_096, 9_000, 123_456]))
    assert running_ids(rows.limit(0), "k").count() == 0


def test_signatures_against_hmac(spark):
    import hashlib
    import hmac

    from passagework.operators import replies

    for secret in ("s", "long" * 40):
        right = "sha256=" + hmac.new(secret.encode(), "बात".encode(), hashlib.sha256).hexdigest()
        rows = spark.createDataFrame([("बात", right), ("बात", right.upper()), ("x", right), (None, right), ("बात", None), ("", "")], "b string, s string")
        assert [r.ok for r in rows.select(replies.signed(F.col("b"), F.col("s"), secret).alias("ok")).collect()] == [True, False, False, False, False, False]


@pytest.mark.parametrize("mode", ["append", "complete", "update"])
def test_feed_results_stay_with_the_executors(spark, tmp_path, mode):
    spark.range(50).select((F.col("id") % 20).alias("id"), F.timestamp_seconds(F.col("id")).alias("at")).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("id bigint, at timestamp").parquet(str(tmp_path / "feed"))
    rows = feeds.handled_once(stream, "id", "at").select("id") if mode == "append" else stream.groupBy("id").count().select("id")
    found = feeds.finished(rows, mode)
    assert found.inputFiles() and sorted(r.id for r in found.collect()) == list(range(20))


def test_feed_without_files(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    stream = spark.readStream.schema("id bigint, at timestamp").parquet(str(tmp_path / "feed"))
    found = feeds.finished(feeds.handled_once(stream, "id", "at"))
    assert found.columns == ["id", "at"] and not found.collect()


def _some_pairs(spark):
    rng = random.Random(4)
    words = "the of tide river moon stone lamp fern oak salt ti the".split()
    vectors = [[rng.choice([0.0, 0.25, -0.5, 0.1234565]) for _ in range(4)] for _ in range(12)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    texts = [line(6) for _ in range(40)]
    questions = spark.createDataFrame([(i, line(5) if i % 3 else None, vectors[i]) for i in range(9)], "qid bigint, qtext string, qv array<float>")
    chunks = spark.createDataFrame([(i, rng.choice(texts) if i % 11 else None, rng.choice(vectors), rng.choice([0, 1, 1, None]), rng.randrange(500)) for i in rng.sample(range(3000), 400)], "cid bigint, text string, cv array<float>, label int, n_chars int")
    text = F.col("text")
    return questions, chunks.select(
        "*", (F.col("label") % 2 == 0).alias("in_syllabus"), (F.col("n_chars") < 200).alias("needs_review"), text.contains("oak").alias("chart_axis"), text.rlike("a").alias("has_numbers"), (F.col("n_chars") < 400).alias("figure"),
        F.regexp_count(text, F.lit("ti")).alias("outside_hits"), F.regexp_count(text, F.lit("the")).alias("inside_hits"),
    ).repartition(2)


def test_pairs_that_matter_give_what_all_pairs_give(spark, monkeypatch):
    questions, chunks = _some_pairs(spark)
    kinds = retrieval.kinds(chunks)
    some = retrieval.scored(questions, kinds, carry=retrieval.CARRIED, best=retrieval.SIGNALS).cache()
    whole = retrieval.scored(questions, kinds, carry=retrieval.CARRIED).cache()
    assert whole.count() == 9 * 400 and some.count() < whole.count() / 5
    known = {(r.qid, r.cid): r for r in whole.collect()}
    assert all(known[r.qid, r.cid] == r for r in some.collect())
    signals = sorted(map(str, retrieval.signals(whole).collect()))
    assert sorted(map(str, retrieval.signals(some).collect())) == signals
    three = lambda pairs, w: sorted((r.qid, r["rank"], r.cid) for r in retrieval.ranked(pairs.withColumn("s", F.round(F.col("dense") + w * F.col("lex"), 6)), 3, "s").collect())
    few = retrieval.scored(questions, kinds, best=[(None, 3)], weights=(0.0, 0.5, 0.8)).cache()
    assert few.count() < whole.count() / 10 and all(three(few, w) == three(whole, w) for w in (0.0, 0.5, 0.8))
    joined = retrieval.dense(questions, chunks).join(retrieval.lexical(questions, chunks), ["qid", "cid"], "left")
    assert {(r.qid, r.cid): round(r.lex or 0, 9) for r in joined.collect()} == {k: round(r.lex, 9) for k, r in known.items()}
    shortened = chunks.withColumn("asked", retrieval.asked_terms(F.col("text"), questions)).drop("text")
    assert {(r.qid, r.cid): round(r.lex, 9) for r in retrieval.scored(questions, shortened).collect()} == {k: round(r.lex, 9) for k, r in known.items()}
    monkeypatch.setattr(retrieval, "QUESTIONS", 3)
    assert sorted(map(str, retrieval.signals(retrieval.scored(questions, kinds, carry=retrieval.CARRIED, best=retrieval.SIGNALS)).collect())) == signals
    monkeypatch.setattr(retrieval, "QUESTIONS", 50_000)
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 2)
    monkeypatch.setattr(retrieval, "CHUNKS_AT_ONCE", 7)
    monkeypatch.setattr(retrieval, "ENTRIES", 5)
    assert sorted(map(str, retrieval.signals(retrieval.scored(questions, kinds, carry=retrieval.CARRIED, best=retrieval.SIGNALS)).collect())) == signals
    assert retrieval.scored(questions.limit(0), chunks, best=[(None, 1)]).count() == 0 == retrieval.scored(questions, chunks.limit(0)).count()


def test_rounded_as_by_spark(spark):
    rng = random.Random(8)
    values = [rng.uniform(-3, 3) for _ in range(3000)] + [k / 1e6 + 5e-7 for k in range(-1500, 1500)] + [0.0, -0.0, -1e-7, 1234.5678905]
    rounded = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(F.round("v", 6).alias("v")).collect()]
    assert [k / 1e6 for k in retrieval.millionths(np.array(values)).tolist()] == rounded
    odd = np.array([[0.1, np.nan, 3.0, 0.2]])
    assert retrieval.leading(odd, [(None, 1)]).all() and retrieval.leading(odd[:, 2:], [(None, 1)]).tolist() == [[True, False]]
