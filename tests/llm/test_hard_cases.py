"""Texts that break parsers, accuracy of the trained operators, and the pipeline against brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillpanel.llm import byte_bpe, common, html_extraction, html_pages, html_tree, mpeg_audio, near_copies, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts
from tests.llm.test_operators import brute_repeats, prose

OPERATORS = [token_counts.op1_token_counts, packing.op2_packing, suffix_dedup.op4_suffix_dedup, quality_rules.op6_quality_rules, simhash.op7_simhash, pii.op8_pii, byte_bpe.op9_byte_bpe, mpeg_audio.op10_mpeg_audio]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def ugly():
    g = random.Random(8)
    out = ["TAG" * 519, "APETAGEX" * 369, "ID3" * 400, "ÿû" * 700, "0" * 5000 + ".1.1.1", "+" + "1" * 6000, "@" * 3000, "<div>" * 2000 + "</section>" * 2000, "a" * 30_000, "漢字" * 4000, "\x00\x01\x7f" * 50, "\n" * 500]
    out += ["TAG" * n for n in range(40, 120, 7)] + ["".join(chr(g.choice((g.randrange(32, 127), g.randrange(0x100, 0xD7FF)))) for _ in range(g.randrange(400))) for _ in range(20)]
    return [*out, out[0], out[0], None, ""]


@pytest.fixture(scope="session")
def hard(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    rows = [(i % 50, t, None, None, None) for i, t in enumerate(ugly())]  # doc_ids repeat as well
    df = spark.createDataFrame(rows, DOCUMENTS).withColumns({"Text_": F.lit("x"), "_salt": F.lit(1), "gram": F.lit(2), "fp": F.lit(3)})
    df.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("query", OPERATORS)
def test_no_text_breaks_an_operator(spark, hard, query):
    got = query(spark, hard)
    n = got.count() if query is not packing.op2_packing else got.where("start = 0").count()
    assert n == len(ugly())


def test_odd_payloads_come_back():
    for text in ugly():
        data = mpeg_audio.padded((text or "").encode())
        media = mpeg_audio.store(data)
        assert mpeg_audio.payload_of(media, mpeg_audio.parse(media)) == data


def test_tags_and_tables_of_other_writers():
    clean = mpeg_audio.store(bytes(range(256)) * 30)
    want = mpeg_audio.parse(clean)
    ape = b"key=value" * 9
    footer = b"APETAGEX" + (2000).to_bytes(4, "little") + (len(ape) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    got = mpeg_audio.parse(clean + ape + footer + b"TAG" + bytes(125))
    assert {"APE", "ID3v1"} <= set(got.tags) and got.offsets == want.offsets and got.duration == want.duration and got.skipped == 0
    hurt = bytearray(clean)
    hurt[want.offsets[3] + 4] ^= 1
    assert mpeg_audio.parse(bytes(hurt)).damaged == [want.offsets[3]]


def test_media_index_has_every_offset(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    rows = mpeg_audio.index_media(mpeg_audio.store_media(docs)).collect()
    assert len(rows) == len(ugly()) and all(r.offsets and not r.damaged and r.n_samples == 1152 * len(r.offsets) for r in rows)


def test_token_tables_stay_bounded():
    u = token_counts.Unigrams({"a": -1.0, "b": -1.5, "ab": -2.0, "▁": -1.0}, nodes=50, known=200, depth=4)
    wide = token_counts.Unigrams(u.scores)
    g = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(g.choice("abc") for _ in range(g.randrange(1, 40))) for _ in range(5))
        a, b = u.measure(text, size=16), wide.measure(text)
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and u.held <= 200 + 16 + 41


@pytest.mark.parametrize("found,x", [
    (True, "write to bob at acme dot org today"), (True, "mail: jane at acme dot co dot uk"), (True, "john dot smith at acme dot com"), (True, "ann at gmail dot com"), (True, "john (at) acme dot com"), (True, "bob@acme dot com"),
    (True, "jоhn@exаmple.com"), (True, "j­oe@ex​ample.com"), (True, "plus four nine three zero one two three four five six seven"), (True, "four one one one one one one one one one one one one one one one"),
    (False, "look at amazon dot com"), (False, "Meet me at example dot com"), (False, "our shop at acme dot com is open"), (False, "look at gmail dot com"), (False, "one two three, go"), (False, "it took one or two days"),
])
def test_disguises_and_prose(found, x):
    assert bool(pii.search(x)[1]) is found


def test_quality_scores_hold_on_rows_not_learnt_from(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = quality_classifier.op3_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.95


def test_empty_tables_of_the_trained_operators(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert quality_classifier.op3_quality_classifier(spark, str(tmp_path)).count() == 0
    assert html_extraction.op5_html_extraction(spark, str(tmp_path)).count() == 0


def overlap(got: str, want: str) -> float:
    a, b = got.split(), want.split()
    both = sum(min(a.count(w), b.count(w)) for w in set(a))
    return 2 * both / max(1, len(a) + len(b))


def test_main_text_of_pages_of_another_seed():
    pages = html_pages.labelled_pages(60, 99)
    scores = []
    for page, got in zip(pages, html_extraction.main_texts(pages, html_extraction.trained())):
        nodes = html_tree.parse(page)
        y = html_extraction._labels(nodes)
        scores.append(overlap(got, " ".join(n.text for n, label in zip(nodes, y) if not n.tag and label)))
    assert np.mean(scores) > 0.95


def test_main_text_of_a_page_of_another_style():
    g = random.Random(3)
    body = [prose(g, 60) + "." for _ in range(5)]
    page = "<body><table><tr><td class=left><a href=a>Home</a> <a href=b>About us</a> <a href=c>Archive</a></td><td><h2>A walk</h2>" + "".join(f"<p>{b}" for b in body) + "</td></tr></table><center><font size=1>Copyright 1999. <a href=m>Mail</a></font></center></body>"
    got = html_extraction.main_texts([page], html_extraction.trained())[0]
    assert overlap(got, "A walk " + " ".join(body)) > 0.9


def test_references_and_stray_tags():
    assert [n.text for n in html_tree.parse("<p>&<b>amp;</b> x <svg>a</p><p>y <math><mi>q</mi></math>") if not n.tag] == ["&amp; x", "y q"]


def test_rows_that_differ_in_nulls_alone_are_two(spark):
    rows = [(1, "x", None, None, 1), (1, None, "x", None, 1)]
    got = near_copies.keep_one(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert len(got) == 2


def test_simhash_alone_links_documents_that_share_no_minhash_key(spark, monkeypatch):
    signatures = near_copies._signatures

    def keyless(batches):
        for batch in signatures(batches):
            yield batch.set_column(batch.schema.get_field_index("at"), "at", pa.array([[]] * len(batch), pa.list_(pa.int64())))

    monkeypatch.setattr(near_copies, "_signatures", keyless)
    g = random.Random(5)
    texts = [prose(g, 2000), prose(g, 2000), None]
    texts += [texts[0] + " end", texts[1] + " end", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 1, 2]


def test_no_folder_of_one_machine_on_a_cluster():
    class Unset:
        master, applicationId = "spark://host:7077", "a"

        def get(self, name, default=None):
            return default

        def getConf(self):
            return self

        def getCheckpointDir(self):
            return None

    class Session:
        conf = sparkContext = Unset()

    with pytest.raises(RuntimeError):
        common._shared_folder(Session())


def test_pipeline_equals_a_brute_force_chain(spark, tmp_path):
    g = random.Random(12)
    shared = prose(g, 70)
    texts = [prose(g, g.randint(40, 160)) for _ in range(12)] + [prose(g, 50) + " " + shared + " " + prose(g, 50) for _ in range(3)]
    texts += [texts[0], texts[1] + " end", "short", None, prose(g, 30) + " mail a.b@c.org now"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    verdicts = {r.doc_id: r.kept for r in quality_rules.op6_quality_rules(spark, str(tmp_path)).collect()}
    left = [i for i in range(len(texts)) if verdicts[i]]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := texts[i].split()) else set() for i in left}
    stay = []
    root = {i: i for i in left}
    for i in left:
        for j in left:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    stay = sorted(set(root.values()))
    data = [texts[i].encode() for i in stay]
    cut = brute_repeats([texts[i] for i in stay])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.durable(stage(spark, docs, str(tmp_path)))
    got = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(got) == stay and all(not re.search(r"a\.b@c\.org", t) for t in got.values())
    for i, d, (n, removed, *_rest) in zip(stay, data, cut):
        plain = got[i].replace("[EMAIL]", "a.b@c.org").encode()
        assert len(plain) == n - removed
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == set(stay)
