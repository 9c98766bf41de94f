import random
import re
import struct
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillpanel.llm import byte_bpe, golay, html_extraction, mpeg_audio, near_copies, packing, pii, quality_rules, simhash, suffix_dedup, token_counts
from quillpanel.llm.common import tokenizer_path

WORDS = "the river runs past old mills and under stone bridges while people walk home from work at dusk in light rain".split()


def prose(g, n):
    return " ".join(g.choice(WORDS) + (str(g.randint(0, 99)) if g.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    g = random.Random(4)
    shared = prose(g, 80)
    out = [prose(g, g.randint(5, 200)) for _ in range(30)]
    out += [prose(g, 40) + "\n" + shared + "\n" + prose(g, 30) for _ in range(4)] + [out[0], out[0], out[3] + " tail"]
    out += [None, "", " \n ", "x", "ab" * 600, prose(g, 9000), "Grüße — naïve 東京 🙂 " * 20, "mail a.b@c.org or +49 (30) 1234-5678, ip 10.0.0.1 card 4111 1111 1111 1111"]
    return out


@pytest.fixture(scope="session")
def sf(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/empty/documents.parquet")
    return str(path)


def brute_tokens(text, pieces):
    """Best segmentation of each pre-token by trying every last piece, without a trie."""
    byte, total, score = min(pieces.values()) - token_counts.BYTE_PENALTY, 0, 0.0
    for word in re.findall(r" ?[^ \n]+|[ \n]", " " + text) if text else []:
        word = word.replace(" ", "\u2581")
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            ways = [] if word[i - 1] in pieces else [(best[i - 1][0] + n * byte, -(-best[i - 1][1] + n))]
            ways += [(best[j][0] + pieces[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in pieces]
            best.append(max(ways))
        total, score = total - best[-1][1], score + best[-1][0]
    return total, score


def test_token_counts_equal_brute_force(spark, sf, texts):
    pieces = token_counts.pieces(tokenizer_path(token_counts.VOCABULARY))
    got = {r.doc_id: r for r in token_counts.op1_token_counts(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        if x and len(x) > 3000:
            continue
        n, score = brute_tokens(x or "", pieces)
        assert got[i].n_tokens == n and got[i].log_probability == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_packing_is_whole_and_tight(spark, sf, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    rows = packing.op2_packing(spark, sf).collect()
    seen, filled = {i: [] for i in want}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc32(struct.pack(f"<{len(ids)}I", *ids))
        seen[r.doc_id].append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, spans in seen.items():
        assert sum(n for _, n in spans) == len(want[i]) and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:]))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048


def test_best_fit_takes_the_tightest_window():
    g = random.Random(1)
    lengths = [g.randint(1, 64) for _ in range(300)]
    got, room = packing.best_fit_decreasing(lengths, 64), []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        room.append(64 - n) if not fits else room.__setitem__(room.index(min(fits)), min(fits) - n)
    assert len({w for w, _ in got}) == len(room)


def brute_repeats(texts, span=200):
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - span + 1):
            count[d[i : i + span]] = count.get(d[i : i + span], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if count[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, x in zip(d, gone) if not x)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, sf, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op4_suffix_dedup(spark, sf).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_crowded_buckets_lose_nothing(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    rows = docs.select(F.col("doc_id").alias("ka"), F.col("doc_id").alias("kb"), F.col("text").cast("binary").alias("text"))
    got = {r.ka: r.spans for r in suffix_dedup.repeated_spans(rows, crowd=2, block_bytes=3000).collect()}
    for i, want in enumerate(brute_repeats(texts)):
        data = (texts[i] or "").encode()
        assert sha256(suffix_dedup.kept(data, got.get(i))[0]).hexdigest() == want[3]


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    of = {i: i for i in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and of[i] != of[j]:
                a, b = sorted((of[i], of[j]))
                of = {k: a if v == b else v for k, v in of.items()}
    return of


def test_simhash_equals_brute_force(spark, sf, texts):
    prints = [brute_fingerprint(t) for t in texts]
    of = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", of[i]) for i, p in enumerate(prints)}


@pytest.mark.parametrize("cap", [None, 3])
def test_links_reach_every_pair_of_two_bits(spark, monkeypatch, cap):
    if cap:
        monkeypatch.setattr(simhash, "CAP", cap)
    g = random.Random(2)
    prints = set()
    for _ in range(25):
        x = g.getrandbits(64)
        prints.add(x)
        for _ in range(8):
            x ^= 1 << g.randrange(64) | 1 << g.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    of = brute_components(prints)
    nodes = spark.createDataFrame([(simhash.signed(p), i) for i, p in enumerate(prints)], "fp long, name long")
    got = {prints.index(r.fp & (1 << 64) - 1): r.name for r in simhash.component_of(nodes).collect()}
    assert got == of


def test_golay_keys_meet():
    g = np.random.default_rng(1)
    words = g.integers(0, 1 << 23, 200)
    near = words ^ (1 << g.integers(0, 23, 200))
    keys = [{} for _ in range(2)]
    for side, w in enumerate((words, near)):
        for row, key in zip(*golay.keys(w.astype(np.int64))):
            keys[side].setdefault(int(row), set()).add(int(key))
    assert all(keys[0][i] & keys[1][i] for i in range(200))


def test_near_copies_equal_brute_force(spark):
    g = random.Random(6)
    texts = [None, " ", "one two", "one two", "one two three"]
    for n in [100] * 8 + [300] * 8 + [1000] * 4:
        words = [str(g.randrange(10**6)) for _ in range(n)]
        texts.append(" ".join(words))
        for changed in (1, 3, 5, 12):
            near = list(words)
            for i in g.sample(range(n), changed):
                near[i] = "other%d" % g.randrange(10**6)
            texts.append(" ".join(near))
    sets = [set(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else set() for t in texts]
    of = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and of[i] != of[j]:
                a, b = sorted((of[i], of[j]))
                of = {k: a if v == b else v for k, v in of.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(set(of.values()))


def test_keys_of_similar_sets_meet():
    g = np.random.default_rng(5)
    met = 0
    for _ in range(300):
        x = g.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = x[:900], x[100:]  # similarity 0.8
        met += bool((near_copies.keys(np.unique(a)) == near_copies.keys(np.unique(b))).any())
    assert met >= 298


def test_byte_pairs_equal_a_library(spark, sf, texts):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = tokenizer_path(byte_bpe.RANKS)
    t = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.op9_byte_bpe(spark, sf).collect()}
    for i, x in enumerate(texts):
        ids = t.encode_ordinary(x or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == sha256((x or "").encode()).hexdigest()


def brute_pii(text):
    def luhn(s):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0

    d = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d(s)) <= 19 and luhn(d(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(d(s)) <= 15),
    }
    out = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_plain_identifiers_equal_the_patterns(spark, sf, texts):
    got = {r.doc_id: r for r in pii.op8_pii(spark, sf).collect()}
    for i, x in enumerate(texts):
        want = brute_pii(x)
        assert got[i].base_sha256 == sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(got[i].spans.split(",")) | {""}


def test_random_identifiers_equal_the_patterns():
    g = random.Random(3)
    for _ in range(3000):
        x = "".join(g.choice("aB1234567890  ..--++@@()%_é") for _ in range(g.randint(0, 60)))
        assert pii.joined(pii.detect(x)) == brute_pii(x), x


def test_disguised_identifiers_map_back():
    x = "write to john (at) example (dot) com soon"
    _, every = pii.search(x)
    assert any(x[s:e] == "john (at) example (dot) com" for k, s, e in every if k == "email")


@pytest.mark.parametrize("kind,part", [("ip", "192[.]168[.]10[.]7"), ("ip", "192 dot 168 dot 10 dot 7"), ("ip", "192.168 (dot) 10 punto 7"), ("email", "anna at firma point com"), ("email", "anna at firma dot gr"), ("email", "anna at mail dot firma dot museum")])
def test_every_dot_disguise_is_found(kind, part):
    x = f"write: {part}, soon"
    assert [(k, x[s:e]) for k, s, e in pii.search(x)[1]] == [(kind, part)]


@pytest.mark.parametrize("x", ["we were at this point in time", "it is at boiling point and steams", "look at the dot on it", "set at 12 point type", "1 dot 2 dot 3", "999 dot 1 dot 1 dot 1"])
def test_prose_is_no_address(x):
    assert pii.search(x)[1] == []


def test_audio_round_trip(spark, sf, texts):
    got = {r.doc_id: r for r in mpeg_audio.op10_mpeg_audio(spark, sf).collect()}
    for i, x in enumerate(texts):
        data = (x or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]))


def test_audio_resynchronises():
    data = mpeg_audio.store(bytes(range(256)) * 40)
    clean, noisy = mpeg_audio.parse(data), mpeg_audio.parse(b"\xff\x00junk" * 5 + data)
    assert mpeg_audio.feature(clean).split(";")[:3] == mpeg_audio.feature(noisy).split(";")[:3]


def test_pages_lose_their_surroundings():
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>Rain &amp; rivers</h1>" + "".join(f"<p>{prose(random.Random(i), 40)}.</p>" for i in range(4)) + "</article><script>var x = 1;</script><footer><p>Copyright 2020 all rights reserved</p></footer></body></html>"
    text = html_extraction.main_texts([page, ""], html_extraction.trained())
    assert text[1] == "" and "Copyright" not in text[0] and "var x" not in text[0] and "News" not in text[0]
    assert all(prose(random.Random(i), 40) in text[0] for i in range(4))


def test_quality_rules_equal_their_sql(spark, sf):
    got = {r.doc_id: r.asDict() for r in quality_rules.op6_quality_rules(spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    rel = con.sql(quality_rules.oracle())
    want = {r["doc_id"]: r for r in (dict(zip(rel.columns, x)) for x in rel.fetchall())}
    assert got == want


def test_quality_rules_stay_native(spark, sf):
    plan = quality_rules.op6_quality_rules(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_pipeline_stages_hand_on_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("Text_", F.lit(1))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.durable(stage(spark, docs, sf))
        assert after.columns == names, name
        docs = after
    kept = {r.doc_id for r in docs.collect()}
    assert kept and corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == len(kept)


@pytest.mark.parametrize("query", [token_counts.op1_token_counts, packing.op2_packing, suffix_dedup.op4_suffix_dedup, quality_rules.op6_quality_rules, simhash.op7_simhash, pii.op8_pii, byte_bpe.op9_byte_bpe, mpeg_audio.op10_mpeg_audio])
def test_empty_tables_give_empty_results(spark, sf, query):
    assert query(spark, f"{sf}/empty").count() == 0


def test_byte_pairs_in_one_queue_equal_one_by_one():
    """Groups of pre-tokens against plain merging, with ranks that fall as pieces grow."""
    from quillpanel.llm.byte_bpe import BytePairs

    def plain(piece: bytes) -> list[int]:
        parts = [bytes([b]) for b in piece]
        while True:
            found = [(pairs.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in pairs.ranks]
            if not found:
                return [pairs.ranks[x] for x in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    g = random.Random(3)
    made = {bytes([b]): b for b in range(256)} | {b"ab": 400, b"aba": 300, b"ba": 401, b"aa": 299, b"aaa": 700, b"bab": 260, b"abab": 257}
    pairs = BytePairs(made, r"\S+|\s+")
    pieces = ["".join(g.choice("abc") for _ in range(g.randrange(1, 12))) for _ in range(3000)] + ["abab", "a" * 999, "ab" * 40_000]
    for piece, code in zip(pieces, pairs.merge([p.encode() for p in pieces])):
        if len(piece) < 1000:
            assert memoryview(code).cast("I").tolist() == plain(piece.encode())
    text = " ".join(pieces)
    assert pairs.decode(pairs.encode(text)) == text.encode()
    assert list(pairs.encode_all(["", "a b", ""])) == [b"", pairs.encode("a b"), b""]


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path(packing.VOCABULARY)
    whole, ours, rnd = Tokenizer.from_file(path), packing.WordIds(path, limit=500), random.Random(5)
    signs = ["abcXYZ éÉßÿÞÐ×÷µªº'sS't<|end of>tx1290 \n\t\rΣİıK­​!#$%&()*+,-./:;=?@[]^_`{|}~\x00\x1c\x85 ÀÖØöø", "abAB éÉßÿÞ 12.,;!\n-%$"]
    made = ["".join(rnd.choice(signs[i % 2]) for _ in range(rnd.randint(0, 60))) for i in range(2000)] + ["Straße schßung über-ÄÖÜß 100%", " \n \n", ""]
    codes = ours.encode(made)
    for text, code, e in zip(made, codes, whole.encode_batch(made, add_special_tokens=False)):
        expected = b"".join(i.to_bytes(4, "little") for i in e.ids)
        assert code == expected
        assert ours.encode_long(text, 7) == expected


def test_pre_tokens_share_the_nodes_of_their_prefixes():
    model = token_counts.Unigrams({"a": -1.0, "b": -1.5, "ab": -2.0, "▁": -1.0})
    model.measure("ab abba\nabb ab")
    words = ["▁ab", "▁abba", "\n", "abb"]
    assert len(model.best) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})
