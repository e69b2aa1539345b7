from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeweave.llm import langid, lm, media, minhash, pieces, tokenbin, toxicity
from tapeweave.llm.arrowtext import slices, text_bytes, word_hashes, word_spans


def test_words_and_slices():
    texts = ["a bb\tc", None, "", " \n", "é x", "a bb"]
    arr = pa.array(texts)
    data, offsets = text_bytes(arr)
    starts, ends, bounds = word_spans(data, offsets)
    raw = data.tobytes()
    words = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(bounds[:-1], bounds[1:])]
    assert words == [(t or "").encode().split() for t in texts]
    h = word_hashes(data, starts, ends)
    assert h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 5
    assert [b - a for a, b in slices(pa.array(["x" * 10] * 5 + ["y" * 100]), limit=25)] == [2, 2, 1, 1]
    assert list(slices(pa.array([], pa.string()))) == []


# --- token files -----------------------------------------------------------------------------


def test_elias_fano_selects():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5], [0, 0, 0, 7, 7, 2**40], np.sort(rng.integers(0, 10**9, 2000)).tolist(), list(range(1000))):
        ef = tokenbin.EliasFano.of(np.array(values, np.int64))
        again, size = tokenbin.EliasFano.unpack(memoryview(ef.pack()))
        assert size == len(ef.pack()) and again.all().tolist() == values and [again.get(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.get(1000)


def test_token_files_round_trip(spark, corner_docs, no_docs, model_files, tmp_path):
    from tokenizers import Tokenizer

    path = model_files("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder = str(tmp_path / "ids")
    files = tokenbin.write_tokens(corner_docs, folder, path, segment_ids=500, partitions=3)
    assert files.count() > 3  # more files than tasks
    got = sorted(tokenbin.read_tokens(files, folder, with_ids=True).collect(), key=lambda r: r["start"])
    rows = sorted(corner_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    for r, want in zip(got, rows, strict=True):
        ids = library.encode(want["text"] or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (want["doc_id"], at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenbin.read_tokens(tokenbin.write_tokens(no_docs, str(tmp_path / "none"), path), str(tmp_path / "none")).collect() == []


def test_parts_of_words_give_the_library_ids(model_files):
    encoder = tokenbin.WordTokenizer(model_files("word_bpe_49k.json"), most=40)
    rng = random.Random(1)
    letters = ["a", "B", "é", "'", "'s", "-", "|", "<|", "0", "7", " ", "\u00a0", "\u0301", "Σ", "日", "»", "<|endoftext|>", "\n", "T", "ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for at in range(0, 400, 50):
        ids, stops = encoder.encode(pa.array(texts[at : at + 50]), 2)
        want = [x.ids + [2] for x in encoder.tokenizer.encode_batch(texts[at : at + 50], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, stops)[:-1]] == want


def test_special_tokens_keep_their_case(model_files):
    encoder = tokenbin.WordTokenizer(model_files("word_bpe_49k.json"), most=40)
    rng = random.Random(2)
    names = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|StartOfText|>"]
    bits = [*names, "<|End", "<", "|", "|>", "endoftext", "A", "b", "É", " ", "\n", "'S", "7", "0", "-"]
    texts = [*names, *["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)], "plain Text"]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        ids, stops = encoder.encode(pa.array(part), 2)
        want = [x.ids + [2] for x in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, stops)[:-1]] == want


# --- transport streams -----------------------------------------------------------------------


def test_streams_round_trip_and_faults():
    for n in (0, 1, 63, 64, 65, 147, 148, 163, 164, 165, 172, 173, 176, 184, 347, 348, 349, 61440, 61441, 200_000):
        payload = media.padded(bytes(i * 7 % 251 for i in range(n)))
        s = media.demux(media.mux(payload))
        assert s.payload == payload and s.gaps == 0 and len(s.timestamps) == -(-len(payload) // media.UNIT)
        assert len(s.access_points) == len(s.timestamps) and s.timestamps == [media.FIRST_PTS + i * media.TICKS for i in range(len(s.timestamps))]
    stream = bytearray(media.mux(media.padded(b"x" * 5000)))
    lost = bytes(stream[: 188 * 5] + stream[188 * 6 :])
    with pytest.raises(ValueError):
        media.demux(lost)  # the PES packet is short
    stream[188 * 4 + 3] ^= 5
    assert media.demux(bytes(stream)).gaps == 2
    stream[20] ^= 255
    with pytest.raises(ValueError):
        media.demux(bytes(stream))
    with pytest.raises(ValueError):
        media.demux(b"\x00" * 188)
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_stream_features(spark, corner_docs, no_docs):
    rows = media.stream_features(media.encode_streams(corner_docs.select("doc_id", "text", F.lit(1).alias("n_bytes"), F.lit("c").alias("media"))))
    got = sorted((r["payload_sha256"], r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in rows.collect())
    want = []
    for r in corner_docs.collect():
        raw = (r["text"] or "").encode()
        p = media.padded(raw)
        want.append((hashlib.sha256(p).hexdigest(), len(raw), len(p), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    assert media.stream_features(media.encode_streams(no_docs)).collect() == []


def test_all_streams_of_the_map_table():
    payloads = [bytes((i * k) % 253 for i in range(n)) for k, n in enumerate((64, 70_000, 200_000, 128, 61440), 3)] * 12
    mixed = media.mux_streams(payloads)
    found = media.elementary_streams(mixed)
    assert [s.payload for s in found] == payloads and [s.pid for s in found] == [media.DATA_PID + k for k in range(60)]
    for s in found:
        assert s.gaps == 0 and s.access_times == s.timestamps == [media.FIRST_PTS + i * media.TICKS for i in range(len(s.timestamps))]
        # Decoding may start at each access point: its packet is the first of a unit of this stream.
        heads = [mixed[p * media.PACKET : p * media.PACKET + 4] for p in s.access_points]
        assert all(h[0] == media.SYNC and h[1] & 0x40 and (h[1] & 31) << 8 | h[2] == s.pid for h in heads)
    with pytest.raises(ValueError):
        media.demux(mixed)
    with pytest.raises(ValueError):
        media.mux_streams([b"x"] * (media.MOST_STREAMS + 1))
    assert len(media.elementary_streams(media.mux_streams([b"x"] * media.MOST_STREAMS))) == media.MOST_STREAMS


def test_counters_of_packets():
    payload = media.padded(b"y" * 3000)
    packets = [media.mux(payload)[i : i + media.PACKET] for i in range(0, len(media.mux(payload)), media.PACKET)]
    twice = media.demux(b"".join(packets[:6] + [packets[5]] + packets[6:]))
    assert twice.payload == payload and twice.gaps == 0
    stuffing = bytes([media.SYNC, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    bare = bytes([media.SYNC, media.DATA_PID >> 8, media.DATA_PID & 255, 0x20 | packets[5][3] & 15, 183, 0]) + b"\xff" * 182
    padded = media.demux(b"".join([stuffing] + packets[:6] + [bare, stuffing] + packets[6:]))
    assert padded.payload == payload and padded.gaps == 0 and padded.access_points == [3]
    with pytest.raises(ValueError):
        media.demux(b"".join(packets[1:]))


def test_parsed_streams_column(spark):
    payloads = [media.padded(b"a" * 150_000), media.padded(b"b")]
    rows = [(1, media.mux_streams(payloads), "c"), (2, None, "c"), (3, media.mux(b"z" * 64), "c")]
    frame = spark.createDataFrame(rows, "doc_id long, media binary, packets string")
    parsed = media.parse_streams(frame)
    got = {r["doc_id"]: r for r in parsed.collect()}
    assert parsed.columns == ["doc_id", "packets", "streams"] and got[2]["streams"] is None and got[2]["packets"] is None
    assert [bytes(s["payload"]) for s in got[1]["streams"]] == payloads and got[1]["packets"] == len(rows[0][1]) // 188
    first = got[1]["streams"][0]
    assert first["timestamps"] == [p["pts"] for p in first["access_points"]] == [90000, 93600, 97200] and first["gaps"] == 0
    seek = parsed.select("doc_id", *[media.access_before(F.get("streams", F.lit(0)), F.lit(t)).alias(f"t{t}") for t in (89999, 95000, 10**9)])
    at = {r["doc_id"]: r for r in seek.collect()}
    places = [p["packet"] * 188 for p in first["access_points"]]
    assert (at[1]["t89999"], at[1]["t95000"], at[1]["t1000000000"]) == (None, places[1], places[2]) and at[2]["t95000"] is None
    assert [r["payload_bytes"] for r in media.stream_features(frame).orderBy("doc_id").collect()] == [150_016, None, 64]


# --- near duplicates -------------------------------------------------------------------------


def weighted_jaccard(a, b):
    bags = []
    for t in (a, b):
        w = t.encode().split()
        bags.append(collections.Counter([b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([b" ".join(w)] if w else [])))
    x, y = bags
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 0.0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefghij") for _ in range(30))
    long = " ".join(str(rng.randrange(50)) for _ in range(400))
    pairs = [(base * 3, base * 2), (long, edited(rng, long, 6)), (long, edited(rng, long, 30)), ("a " * 3000, "a " * 2000), (long, base), ("a " * 9, "a " * 9)]
    for a, b in pairs:
        codes = minhash.bag_signatures(*minhash.shingles(pa.array([a, b])), 2, places=4000)
        want = weighted_jaccard(a, b)
        assert abs((codes[0] == codes[1]).mean() - want) < 0.035, (want, (codes[0] == codes[1]).mean())
        assert minhash.similarities(pa.array([a]), pa.array([b]))[0] == pytest.approx(want)


def test_classes_against_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for group in range(12):
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([12, 60, 150])))
        docs += [edited(rng, text, rng.choice([0, 1, 2, 4, 8])) for _ in range(8)]
    docs += [docs[0]] * 40 + ["", "", "short one", "short one", "short two", None, None]
    # A chain whose ends are far apart, and a hot group whose members differ from its centre.
    chain = [f"c{i}" for i in range(150)]
    for i in range(14):
        docs.append(" ".join(chain))
        chain[i * 7] = f"n{i}"
    n = len(docs)
    label = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        a, b = docs[i], docs[j]
        if a is not None and b is not None and (a == b or weighted_jaccard(a, b) >= 0.8):
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for tile in (1024, 5):
        got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(rows, tile=tile).collect()}
        assert got == dict(enumerate(label))


def test_classes_of_corner_cases(spark, corner_docs, no_docs):
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in minhash.duplicate_classes(corner_docs).collect())
    assert got[(2, 1)] == 2 and got[(1, 1)] == 1 and got[(3, 3)] == 1 and got[(None, None)] == 1 and got[(4, 4)] == 1 and sum(got.values()) == 12
    assert minhash.duplicate_classes(no_docs).collect() == []


# --- languages and toxicity ------------------------------------------------------------------

VOCABULARY = {
    "en": "the and of that house river green walking through morning people light water under stone".split(),
    "de": "der und nicht das haus grün durch morgen leute licht wasser unter stein schön müde".split(),
    "fr": "le et que maison rivière vert matin gens lumière eau sous pierre très fatigué où".split(),
}


def language_rows(n=240, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(3, 40))), lang) for i in range(n) for lang in [("en", "de", "fr")[i % 3]]]


def test_language_on_held_out_rows(spark, corner_docs, no_docs):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, F.col("doc_id") % 5 != 0)
    got = langid.identify_languages(docs, model).filter("doc_id % 5 = 0").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, "Это другой язык, которого никто не учил"), (2, None), (3, ""), (4, "123 !!"), (5, "这是另一种语言")], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.identify_languages(odd, model).collect()} == {"und"}
    assert langid.identify_languages(corner_docs, model).count() == 12
    assert langid.identify_languages(no_docs, model).collect() == []
    none = langid.fit_languages(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify_languages(docs, none).collect()} == {"und"}


def test_every_language_is_learned_whatever_its_copies(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(12):
        words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(30)]
        rows += [(" ".join(words), f"l{i:02}")] * 200
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = langid.fit_languages(docs, F.lit(True), per_lang=20)
    assert sorted(set(model.langs)) == [f"l{i:02}" for i in range(12)]
    got = langid.identify_languages(docs.distinct(), model).collect()
    assert len(got) == 12 and all(r["lang"] == r["lang_pred"] for r in got)


def test_languages_are_clustered_on_a_bounded_number_of_distinct_texts(spark):
    rows = [(t, lang) for _, t, lang in language_rows(300)]
    docs = spark.createDataFrame(rows + rows[:60] * 40, "text string, lang string").repartition(5)
    model = langid.fit_languages(docs, F.lit(True), per_lang=25)
    assert model.texts == {"en": 25, "de": 25, "fr": 25}
    assert langid.fit_languages(docs, F.lit(True), per_lang=1000).texts == {"en": 100, "de": 100, "fr": 100}
    again = langid.fit_languages(docs.repartition(2), F.lit(True), per_lang=25)
    assert (again.centroids == model.centroids).all() and again.langs == model.langs


def test_language_scores_equal_dense_cosines():
    """Counts, weights and the nearest centroid, gram by gram, for a model with given centroids."""
    import pyarrow as pa

    rng, dims = np.random.default_rng(1), 64
    texts = ["Abc abd.", "é12 é", "", "a" * 50, "xyz, xyz! Xy z", " \n ", "zz\tzz"]
    idf, centroids = rng.random(dims) + 0.1, langid.unit_rows(rng.random((5, dims)))
    model = langid.LanguageModel(["a", "a", "b", "c", "c"], centroids, np.full(5, 0.9), np.full(5, 0.05), idf, 0.5)
    langs, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        squeezed = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode())
        counts = np.zeros(dims)
        for n in (2, 3):
            for i in range(len(squeezed) - n + 1):
                code = 0
                for byte in squeezed[i : i + n]:
                    code = (code * 257 + byte) % 2**32
                counts[(code * 2654435761) % 2**32 >> 32 - 6] += 1
        x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
        x = x / max(np.sqrt(x @ x), 1e-300) if x.any() else x
        cosine = centroids @ x
        best = cosine.argmax()
        lettered = any(c.isalpha() for c in text)
        sure = lettered and cosine[best] >= 0.5 * min(0.9, 0.05 * x.sum())
        assert lang == (model.langs[best] if sure else "und") and abs(score - (cosine[best] if lettered else 0)) < 1e-12


def test_ftrl_equals_the_rule_coordinate_by_coordinate():
    rng = np.random.default_rng(8)
    rows = [(np.unique(rng.integers(0, 32, rng.integers(0, 9))), int(rng.random() < 0.4)) for _ in range(60)]
    got, bias = toxicity.ftrl(rows, 5, 3, 0.5, 1.0, 0.3, 0.7, (1.0, 2.5))
    z, n, bias_n, want_bias = [0.0] * 32, [0.0] * 32, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= 0.3 else -(z[i] - math.copysign(0.3, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.7)
    for _ in range(3):
        for buckets, label in rows:
            w = {int(i): weight(i) for i in buckets}
            g = (1 / (1 + math.exp(-(sum(w.values()) + want_bias))) - label) * (1.0, 2.5)[label]
            for i, old in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * old
                n[i] += g * g
            bias_n += g * g
            want_bias -= 0.5 * g / (1.0 + math.sqrt(bias_n))
    np.testing.assert_allclose(got, [weight(i) for i in range(32)], atol=1e-6)
    assert abs(bias - want_bias) < 1e-9 and any(w == 0 for w in got)


def test_toxicity_on_held_out_rows(spark, corner_docs, no_docs):
    rng = random.Random(4)
    rows = []
    for i in range(2000):
        words = [rng.choice(VOCABULARY["en"]) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Rotten!", "***vile***", "scoundrel,"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    model = toxicity.fit_toxicity(docs.drop("toxic"), labels, F.col("doc_id") % 3 != 1)
    got = toxicity.score_toxicity(docs, model).filter("doc_id % 3 = 1").collect()
    toxic, clean = ([r["score"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert min(toxic) > max(clean) and max(clean) < 0.7 and sum(x >= 0.7 for x in toxic) > 0.9 * len(toxic)
    assert (model.weights != 0).sum() < 1000
    scored = toxicity.score_toxicity(corner_docs, model)
    assert scored.count() == 12 and scored.schema["score"].dataType.simpleString() == "double"
    assert {r["score"] for r in scored.filter("doc_id in (3, 4, 5)").collect()} == {1 / (1 + math.exp(-model.bias))}
    assert toxicity.score_toxicity(no_docs, model).collect() == []
    untaught = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {round(r["score"], 6) for r in toxicity.score_toxicity(docs, untaught).collect()} == {round(1 / (1 + math.exp(4)), 6)}


# --- language model --------------------------------------------------------------------------


@pytest.mark.parametrize("head", [0, 5, 10**6])
def test_scores_against_counts(spark, corner_docs, head):
    rows = corner_docs.select("doc_id", "text").collect() + [(100 + i, t) for i, t, _ in language_rows(60)]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    got = lm.score_texts(docs, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)), head_words=head).collect()
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [((r[1] or "").encode().translate(fold).split() + [None], r[0] is None or r[0] % 7 != 2) for r in rows]
    count = collections.Counter(t for ts, train in tokens if train for t in ts)
    total, kinds = sum(count.values()), len(count)
    want = sorted(
        (str(r[0]), len(ts), sum(count[t] > 0 for t in ts), total, round(sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in ts), 6))
        for r, (ts, _) in zip(rows, tokens)
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["score"])
    assert len(by_id[2]) == 1  # repeated rows score alike


def test_word_probabilities_add_up():
    
    rng = np.random.default_rng(0)
    model = lm.MixedModel([lm._packed(rng.integers(0, 5, (2, 1 << bits)).astype(np.uint16)) for bits in lm.SLOT_BITS])
    # Bit by bit over all 256 next bytes, the predictions of one context add up to 1.
    events = lm.Events.of([b"ab" + bytes([c]) for c in range(256)])
    at = np.flatnonzero(np.arange(events.symbols.size) % 4 == 2)
    total = np.zeros(events.symbols.size)
    for b, bits, slots in events.bits():
        x, gate = model.inputs(b, bits, slots, False)
        p = model.refined(model.logit(x, gate), gate)
        total += np.log(np.where(bits == 1, p, 1 - p))
    assert np.exp(total[at]).sum() == pytest.approx(1.0)
    counts = np.array([0, 1, 7, 4096, 5000, 10**6, 10**9])
    assert np.allclose(lm._expand(lm._compact(counts)), counts, rtol=1e-3)


def test_nothing_to_score(spark, no_docs):
    assert lm.score_texts(no_docs, F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_texts(docs, F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0), (1, 0, 0)] and all(math.isfinite(r["score"]) for r in got)


# --- pieces ----------------------------------------------------------------------------------


def every_segmentation(model, unit):
    text = "".join("\0" if c == "▁" else "▁" if c == " " else c for c in unit)

    def walk(i):
        if i == len(text):
            yield 0.0, ()
            return
        for k in range(1, min(model.longest, len(text) - i) + 1):
            piece = model.pieces.get(text[i : i + k]) or ((-2, model.unknown) if k == 1 else None)
            if piece:
                for s, path in walk(i + k):
                    yield s + piece[1], (k, *path)

    return sorted((-s, tuple(-k for k in path)) for s, path in walk(0))


def test_n_best_of_units(model_files):
    model = pieces.PieceModel(model_files("piece_bpe_32k.model"))
    units = [" the", " hello", " thatthe", "\n", " ", "   x", "é♞a", " aa▁", " erenint", " 1234", " ouein", "q"]
    flat, counts, scores, gaps = model.best(units)
    for i, unit in enumerate(units):
        every = every_segmentation(model, unit)
        found = model.n_best(unit, 4)
        assert [-s for s, _ in found] == [s for s, _ in every[:4]]
        assert scores[i] == -every[0][0] and gaps[i] == (every[1][0] - every[0][0] if len(every) > 1 else math.inf)
        best = flat[counts[:i].sum() : counts[: i + 1].sum()].tolist()
        assert best in [ids for s, ids in found if s == found[0][0]]


def test_lattice_lists_only_edges_that_exist(model_files):
    model = pieces.PieceModel(model_files("piece_bpe_32k.model"))
    text = "▁the♞▁erenint▁zzqx"
    chars = np.array([ord(c) for c in text], np.uint32)
    stops = np.where(np.arange(len(text)) < 5, 5, len(text))
    got = sorted(zip(*(x.tolist() for x in model.lattice(chars, stops))))
    want = []
    for i in range(len(text)):
        for k in range(1, min(model.longest, stops[i] - i) + 1):
            piece = model.pieces.get(text[i : i + k]) or ((-2, model.unknown) if k == 1 else None)
            want += [(i, k, *piece)] if piece else []
    assert got == want and len(got) < len(text) * model.longest / 2
    assert [len(x) for x in model.best([])] == [0, 0, 0, 0]


def test_best_of_units_of_all_lengths(model_files):
    model = pieces.PieceModel(model_files("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    units = [" " + "".join(rng.choice(list("etaoin♞"), n)) for n in [*range(1, 9), *[5] * 20]] + [" " + "the" * 700, "é" * 300]
    flat, counts, scores, gaps = model.best(units)
    ends = np.cumsum(counts)
    for i, unit in enumerate(units):
        found = model.n_best(unit, 2)
        assert scores[i] == pytest.approx(found[0][0]) and gaps[i] == pytest.approx(found[0][0] - found[1][0] if len(found) > 1 else math.inf, abs=1e-6)
        alone = model.best([unit])
        assert flat[ends[i] - counts[i] : ends[i]].tolist() == alone[0].tolist() and scores[i] == alone[2][0]


def test_n_best_of_texts(model_files):
    path = model_files("piece_bpe_32k.model")
    segmenter = pieces.Segmenter(path, 4, most=10)
    texts = ["the hen", "a a a", "", "of it\nis", "zz"]
    *_, ranked, same = segmenter.segment(pa.array(texts))
    assert same.all()
    for text, rows in zip(texts, ranked):
        every = every_segmentation(segmenter.model, " " + text if text else "")
        assert [r["score"] for r in rows] == [-s for s, _ in every[:4]]
        assert len({r["ids_crc32"] for r in rows}) == len(rows)


def test_pieces_round_trip(spark, corner_docs, no_docs, model_files):
    path = model_files("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(corner_docs.select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("n")), path)
    got = sorted(((str(r["doc_id"]), r["text"]) for r in pieces.decode_pieces(encoded, path).collect()))
    assert got == sorted((str(r["doc_id"]), r["text"] or "") for r in corner_docs.collect())
    assert all(r["round_trip"] for r in encoded.collect())
    assert pieces.decode_pieces(pieces.encode_pieces(no_docs, path), path).collect() == []
