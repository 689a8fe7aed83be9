import bz2
import gzip

import pytest

from gleanery.functions import ids, wikitext
from gleanery.functions.text import STOP_WORDS, alnum_terms, normalize_word, terms
from gleanery.sources import tables


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("1045", 1045), ("MED-911", 911), ("632589828c8b9fca2c3a59e97451fde8fa7d188d", 2277164672189146571),
        ("test-environment-aeghhgwpe-pro02b", 17880531886978462505), ("4d3d4471-2019-04-18T11:45:01Z-00002-000", 16211700675218413973),
        ("18446744073709551615", 18446744073709551615), ("+7", 7),
    ],
)
def test_parse_id(spark, text, number):
    assert ids.parse_id(text) == number
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] and int(r[0]) for r in df.select(ids.parse_id_column(df.t)).collect()] == [number, None]


@pytest.mark.parametrize(("value", "unit", "shown"), [(-500, "V", "-500.00 V"), (1000, "m/sec", "1.00 Km/sec"), (2500.0, "W", "2.50 KW"), (0.015, "l", "0.01 l"), (0, "B", "0.00 B"), (1024, "B", "1.02 KB"), (3.2e9, "B", "3.20 GB")])
def test_format_si(value, unit, shown):
    assert ids.format_si(value, unit) == shown


def test_terms(spark):
    rows = [("It's C++ 2024, naïve\u0085ⒶB",), ("  \t",), (None,), ("İstanbul ΣΑΣ",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(terms(df.t)).collect()]
    assert got[:3] == [["its", "c", "naïve", "ⓐb"], [], []]
    assert got[3] == [normalize_word("İstanbul"), "σας"]
    assert [r[0] for r in df.select(alnum_terms(df.t)).collect()][0] == ["it", "s", "c", "2024", "naïve", "ⓐb"]
    assert len(STOP_WORDS) == 33 and "not" in STOP_WORDS


CISI = """.I 1
.T
First title
.A
Some, A.
.W
one line
two line
.X
1 5 1
.I 2
.T
Second
.W
body
.I 3
.W
last
"""


def test_cisi(spark, tmp_path):
    (tmp_path / "CISI.ALL").write_text(CISI)
    (tmp_path / "CISI.QRY").write_text(".I 1\n.W\nwhat is\nthis\n.I 2\n.T\nskip\n.W\nsecond\n")
    (tmp_path / "CISI.REL").write_text("     1      1 0 0.000000\n     1      2 0 0.000000\n")
    data = tables.dataset(spark, "cisi", str(tmp_path))
    docs = {r.doc_id: r.text for r in data.docs.collect()}
    assert docs == {1: "First title Some, A. one line two line", 2: "Second body", 3: "last"}
    compat = {r.doc_id: r.text for r in tables.cisi_docs(spark, str(tmp_path / "CISI.ALL"), compat=True).collect()}
    assert compat == {1: "First titleSome, A.one linetwo line", 2: "Secondbody"}
    assert {r.query_id: r.text for r in data.queries.collect()} == {1: "what is this ", 2: "second "}
    assert sorted(tuple(r) for r in data.qrels.collect()) == [(1, 1, 1.0), (1, 2, 1.0)]
    (tmp_path / "CISI.REL").write_text("9 1 0 0.0\n")
    with pytest.raises(Exception, match="query should exist"):
        tables.cisi(spark, str(tmp_path)).qrels.collect()


def beir_files(folder):
    (folder / "qrels").mkdir()
    (folder / "corpus.jsonl").write_text('{"_id": "MED-1", "title": "T", "text": "one"}\n{"_id": "2", "title": "", "text": "two"}\n')
    (folder / "queries.jsonl").write_text('{"_id": "7", "text": "first"}\n{"_id": "7", "text": "again"}\n{"_id": "8", "text": "no judgment"}\n')
    (folder / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\n7\tMED-1\t1\n7\t2\t0\n7\tMED-1\t2\n")


def test_beir(spark, tmp_path):
    beir_files(tmp_path)
    data = tables.dataset(spark, "beir_x", str(tmp_path))
    assert sorted((int(r.doc_id), r.text) for r in data.docs.collect()) == [(1, "T one"), (2, " two")]
    assert [(int(r.query_id), r.text) for r in data.queries.collect()] == [(7, "first")]
    assert [(int(r.query_id), int(r.doc_id), r.relevance) for r in data.qrels.collect()] == [(7, 1, 2.0)]
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "text": "no title"}\n')
    with pytest.raises(Exception, match="title"):
        data.docs.collect()


def test_beir_parquet(spark, tmp_path):
    beir_files(tmp_path)
    (tmp_path / "corpus.jsonl").unlink()
    spark.createDataFrame([("1", "T", "one")], "_id string, title string, text string").write.parquet(str(tmp_path / "corpus"))
    spark.createDataFrame([("7", "x", "q")], "_id string, title string, text string").write.parquet(str(tmp_path / "queries"))
    data = tables.dataset(spark, "nfcorpus", str(tmp_path))
    assert [(int(r.doc_id), r.text) for r in data.docs.collect()] == [(1, "T one")] and data.queries.count() == 1
    spark.createDataFrame([("1", "T", "one", 1)], "_id string, title string, text string, more int").write.mode("overwrite").parquet(str(tmp_path / "corpus"))
    with pytest.raises(ValueError, match="more"):
        tables.beir_docs_parquet(spark, str(tmp_path / "corpus"))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "wiki.json"
    path.write_text("".join(f'{{"url": "u", "title": "t", "body": "b{i}"}}\n' for i in range(5)))
    data = tables.dataset(spark, "enwiki_json", str(path))
    assert sorted(tuple(r) for r in data.docs.collect()) == [(i, f"b{i}") for i in range(5)]
    for missing in ("queries", "qrels"):
        with pytest.raises(NotImplementedError):
            getattr(data, missing)
    path.write_text('{"body": "x"}\n{"body": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.json_docs(spark, str(path)).collect()


def test_wiki_dump(spark, tmp_path):
    page = lambda ns, *revisions: f"<page><title>T{ns}</title><ns>{ns}</ns>" + "".join(f"<revision><timestamp>{t}</timestamp><text>{x}</text></revision>" for t, x in revisions) + "</page>"
    dump = "<mediawiki>" + page(0, ("2020", "old"), ("2022", "new [[link|label]]"), ("2023", "{{only|template}}")) + page(1, ("2021", "talk")) + page(0, ("2021", "== Head ==\ntext")) + "</mediawiki>"
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress(dump.encode()))
    docs = tables.dataset(spark, "simplewiki", str(path)).docs.orderBy("doc_id").collect()
    assert [tuple(r) for r in docs] == [(0, "new label"), (1, "Head text")]


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("plain", "plain"), ("a '''bold''' b ''it'' c", "a  b  c"), ("{{t|{{u}}}}x", "x"), ("[[A]] and [[B|b c]]", "A and b c"), ("[[File:x.png|thumb|[[A]] cap]]y", "y"),
        ("[[Category:C]]z", "z"), ("[http://e.org label] [http://e.org]", "label"), ("* one\n* two", "one  two"), ("a&nbsp;b &amp; c<ref>n</ref><br/>d", "a b & cd"),
        ("{| class=x\n| cell\n|}\nafter", "after"), ("#REDIRECT [[X]]", ""), ("<!-- c -->x\ty", "x y"), ("", ""),
    ],
)
def test_wikitext(markup, text):
    assert wikitext.strip_wikitext(markup) == text


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    for suffix in ("gz", "gzip"):
        (tmp_path / f"a.{suffix}").write_bytes(gzip.compress(b"x\ny\n"))
    for suffix in ("txt", "gz", "gzip"):
        assert [r.value for r in tables.text_lines(spark, str(tmp_path / f"a.{suffix}")).collect()] == ["x", "y"]
    with pytest.raises(ValueError, match="extension"):
        tables.text_lines(spark, str(tmp_path / "noextension"))


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        tables.dataset(spark, "other", "/nowhere")


@pytest.mark.parametrize("line", ["1\t2", "1", "1\t2\tmany"])
def test_a_broken_judgment_is_an_error(spark, tmp_path, line):
    (tmp_path / "test.tsv").write_text(f"query-id\tcorpus-id\tscore\n1\t2\t1\n{line}\n\n")
    with pytest.raises(Exception, match="a judgment should have"):
        tables.beir_qrels(spark, str(tmp_path / "test.tsv")).collect()
