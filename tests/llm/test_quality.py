import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattiq.llm import quality as q

WORDS = ["the", "of", "is", "and", "was", "der", "und", "était", "été", "que"]
HASHES = {q.word_hash(q.fold(w)) for w in WORDS}
TABLE = np.array(sorted(HASHES), np.uint64)


def state(text):
    data = np.frombuffer(text.encode(), np.uint8)
    m = q.measure(data, np.array([0, len(data)]), TABLE)
    return {k: v[0].item() for k, v in m.items()}


def final(s):
    """Figures of a whole text from its state."""
    r = {k: s[k] for k in q.SUMS}
    for p in ("h_",) if s["one_line"] else ("h_", "t_"):
        q._close(r, {k: s[p + k] for k in q.LINE})
    return r


@given(st.text(alphabet="the of.\n\r É-1?{*€ ", max_size=60), st.lists(st.integers(0, 60), max_size=4))
@settings(max_examples=400, deadline=None)
def test_cuts_do_not_matter(text, cuts):
    """Merged chunks give the figures of the whole text, whatever the order of merging."""
    cuts = sorted({min(c, len(text)) for c in cuts})
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    whole = final(state(text))
    left = state(parts[0])
    for p in parts[1:]:
        left = q.join(left, state(p), HASHES)
    right = state(parts[-1])
    for p in reversed(parts[:-1]):
        right = q.join(state(p), right, HASHES)
    for got in (final(left), final(right)):
        for k in ("n_chars", "n_visible", "n_words", "n_letters", "n_common", "n_symbols", "n_lines", "n_closed"):
            assert got[k] == whole[k], k


def test_counts():
    r = final(state("The été is.\n\n x_1 $$\nof"))
    assert (r["n_words"], r["n_common"], r["n_lines"], r["n_closed"]) == (5, 4, 3, 1)
    assert r["n_symbols"] == 4 and r["n_letters"] == 11 and r["n_chars"] == 23


def run(spark, texts, chunk=q.CHUNK):
    docs = spark.createDataFrame([(i, t, "x", 1, True) for i, t in enumerate(texts)], "doc_id bigint, text string, block string, chunk int, one_line boolean")
    words = spark.createDataFrame([("en", w) for w in WORDS] + [("en", None)], "lang string, word string")
    return {r.doc_id: r for r in q.statistics(docs, words, chunk).collect()}


PROSE = "The part of the engine that reads the file is slow, and the reason was found. It is the size of the page.\n"
CODE = "for (int i = 0; i < n; i++) { the[i] = of(i, \"is\"); }\n"
LIST = "- merge the page.\n- read the file of it.\n"


def test_verdicts(spark):
    salad = "page file the engine\nreader of valve\nis matrix socket\n"
    texts = [PROSE * 3, CODE * 5, LIST * 9, salad * 5, PROSE + CODE * 9, PROSE * 4 + CODE * 2, "// " + PROSE.replace("\n", "\n// ") * 2, "<p>" + PROSE.strip() + "</p>\n", "", None, "  \n\t\n", "word " * 500]
    got = run(spark, texts)
    assert [i for i, r in sorted(got.items()) if r.is_prose] == [0, 5, 6, 7]
    assert got[9].n_chars == 0 and got[9].prose_share == 0 and len(got) == len(texts)


def test_chunked_documents(spark):
    rng = np.random.default_rng(0)
    texts = ["".join([PROSE, CODE, LIST, "x" * 40, "\n"][i] for i in rng.integers(0, 5, 40)) for _ in range(6)] + [PROSE * 60, "a" * 5000, "\n" * 500]
    whole, cut = run(spark, texts), run(spark, texts, 97)
    fine = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_share", "closed_line_share", "common_word_share")
    for i in whole:
        for k in fine:
            assert getattr(whole[i], k) == pytest.approx(getattr(cut[i], k)), k
        assert whole[i].prose_share == pytest.approx(cut[i].prose_share, abs=0.1)
        assert whole[i].is_prose == cut[i].is_prose


def test_repeated_and_empty(spark):
    assert run(spark, []) == {}


def test_folding():
    for word in ("Straße", "ÉTÉ", "МОСКВА", "ΑΘΗΝΑ", "ŽIŽKA", "ＡＢＣ", "ẼẼ"):
        assert q.fold(word) == word.lower().encode()
    assert q.fold("ß") == "ß".encode()
    r = final(state("ÉTAIT Était dort"))
    assert r["n_words"] == 3 and r["n_common"] == 2


def test_spread_documents(spark):
    """A text of many chunks is measured by several tasks, with the figures of the text as a whole."""
    text = (PROSE + CODE + "Ünïcode € sentence of the été. " + "\n") * 400
    docs = spark.createDataFrame([(1, text), (2, "the"), (3, None), (4, "x" * 5000)], "doc_id bigint, text string")
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    whole = q.chunk_states(docs, words, 1 << 24)
    cut = q.chunk_states(docs, words, 1000, spread=4000)
    assert {r.doc_id: r["count"] for r in cut.groupBy("doc_id").count().collect()}[1] > 70
    table, common = q._hashes(words)
    got = {r.doc_id: r.asDict() for r in q.merged(q.merged(cut, ["doc_id", "block"], common), ["doc_id"], common).collect()}
    want = {r.doc_id: r.asDict() for r in whole.collect()}
    for i in want:
        a, b = final(got[i]), final(want[i])
        assert {k: a[k] for k in a if k != "n_prose"} == {k: b[k] for k in b if k != "n_prose"}


def test_counts_against_sql(spark):
    import duckdb

    from lattiq.llm import queries

    con = duckdb.connect()
    for t in ("documents", "common_words"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    df = queries.p9_counts(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").sort_index()
    want = con.execute(queries.ORACLE["p9_counts"]).df().set_index("doc_id").sort_index()[list(df.columns)]
    for c in df:
        assert np.allclose(df[c].astype(float), want[c].astype(float), rtol=0, atol=1e-9), (c, df[c][~np.isclose(df[c].astype(float), want[c].astype(float))].head())
