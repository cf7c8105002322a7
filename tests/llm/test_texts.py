import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import lm, lm_model, ngram_join, packing, pieces, suffix_dedup, tokenfile, toxicity, trie, wordtokens
from tessera.llm.words import text_chunks
from tessera.storage import scratch_path

FOLDER = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [(400, None), (401, ""), (402, " \t\n"), (403, "x"), (404, "X"), (405, "é ü ß x y z"), (406, "a" * 5000), (405, "é ü ß x y z")]


def frame(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "score": F.lit("s"), "class": F.lit(None).cast("string"), "i": F.lit(2), "t": F.lit("t")})


def documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    return df, [tuple(r) for r in df.collect()]


# n-gram join


@pytest.mark.parametrize("block,hot", [(512, 1 << 20), (4, 9)])
def test_near_duplicates(spark, block, hot):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [draw.choice(words) for _ in range(60)]
    rows = [(i, " ".join(w if draw.random() > 0.02 else draw.choice(words) for w in base)) for i in range(60)]
    rows += [(200 + i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 9)))) for i in range(80)] + [r for r in ODD if r[0] != 405]
    found = ngram_join.near_duplicates(frame(spark, rows), block=block, bucket_bits=2, hot=hot, often=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.near_duplicates(rows)


def test_near_duplicates_of_repeated_and_no_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(r["component_id"] for r in got) == [5, 5, 5, 5]
    assert ngram_join.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_trie_equals_all_pairs():
    draw = random.Random(8)
    for _ in range(40):
        base = [draw.randrange(80) for _ in range(40)]
        sets = [sorted({x if draw.random() > 0.07 else draw.randrange(80) for x in base}) for _ in range(25)]
        got = trie.link_sets([len(s) for s in sets], [np.array(s) for s in sets], 80)
        links = [(i, j) for i in range(25) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})]
        want = brute.components(list(range(25)), links)
        assert got == [want[i] for i in range(25)]


# suffix arrays


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_passages(spark, hot):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passages = [[draw.choice(words) for _ in range(n)] for n in (49, 50, 51, 120)]
    rows = []
    for i in range(40):
        text = [draw.choice(words) for _ in range(draw.randint(0, 150))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            k = draw.randint(0, len(text))
            text[k:k] = p[draw.randint(0, 3) :]
        rows.append((i, "  ".join(text)))
    rows += [(100 + i, " ".join("a" * (45 + i))) for i in range(10)] + [(203, " ".join(words[:120] * 2)), (204, rows[3][1].upper()), (205, rows[3][1]), (None, rows[3][1])]
    rows += [r for r in ODD if r[0] != 405]
    df = frame(spark, rows)
    got = [tuple(r) for r in suffix_dedup.repeated_windows(df, hot=hot).select("doc_id", "start", "low").collect()]
    assert len(got) == len(set(got)) and set(got) == brute.repeated_windows(rows)
    covered: dict = {}
    for d, start, low in got:
        if low < d:
            covered.setdefault(d, set()).update(range(start, start + 50))
    out = suffix_dedup.remove_repeats(df, hot=hot)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for d, text in rows:
        if d not in covered:
            assert texts[d] == text
        else:
            assert brute.words(texts[d]) == [w for k, w in enumerate(brute.words(text)) if k not in covered[d]]


def test_no_passages(spark):
    assert suffix_dedup.repeated_spans(frame(spark, ODD)).count() == 0
    assert suffix_dedup.repeated_spans(frame(spark, ODD).limit(0)).count() == 0


def test_spans_belong_to_a_row(spark):
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(words[:70])
    rows = [(1, passage), (2, "only three words"), (2, " ".join(words[200:230]) + " " + passage), (2, None), (2, "only three words"), (None, passage), (3, "")]
    df = frame(spark, rows).withColumns({"_spans": F.lit(1), "_span_doc": F.lit("x"), "text_key": F.lit(0)})
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert texts == sorted((d or 0, (t or "") if d != 2 or t is None or passage not in t else t[: -len(passage)]) for d, t in rows)


# tokens


def whole(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cached_runs_equal_the_tokenizer():
    texts = ["A b\nc.  d", None, "", "İ é. Éa, <|endoftext|>z don't, it's. a…. b…", "q r \x1cs. .,", ". , a.. 1. 12, ", "a" * 3000 + " b", "ﬁ ½ 中文字. 한국어, e\u0301"]
    tokenizer = wordtokens.WordTokenizer(WORDS)
    for row, count, data, offsets in text_chunks(pa.array(texts)):
        ids, first = tokenizer.encode(data, offsets)
        assert [ids[first[k] : first[k + 1]].tolist() for k in range(count)] == whole(texts[row : row + count])


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000)
    words = tokenfile.pack_ids(ids, width)
    assert len(words) == width * 16 and (tokenfile.unpack_ids(words, width, 1000) == ids).all()


def test_token_files(spark, tmp_path):
    import io

    docs, rows = documents(spark)
    files = tokenfile.write_token_files(docs.unionByName(spark.createDataFrame(ODD[:4], "doc_id long, text string")), scratch_path(spark, "t"), WORDS, 2)
    rows = sorted(rows + ODD[:4])
    want = [ids + [2] for ids in whole([t for _, t in rows])]
    starts = np.cumsum([0] + [len(x) for x in want]).tolist()
    got = sorted(tuple(r) for r in tokenfile.read_token_files(files).collect())
    assert got == [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), s, x in zip(rows, starts, want, strict=False)]
    image = tokenfile.file_image([d for d, _ in rows], np.array(starts), np.concatenate(want), 16, block=64)
    file = tokenfile.TokenFile(io.BytesIO(image))
    for i in (0, 7, len(rows) - 1):
        assert file.document(i).tolist() == want[i]
    assert tokenfile.read_token_files(tokenfile.write_token_files(docs.limit(0), scratch_path(spark, "t"), WORDS, 2)).count() == 0


def test_token_files_of_odd_rows(spark):
    rows = [(7, "a b"), (None, "c"), (7, "a b"), (7, None), (3, "zz " * 40_000), (7, "other words")]
    got = tokenfile.read_token_files(tokenfile.write_token_files(frame(spark, rows), scratch_path(spark, "t"), WORDS, 2)).collect()
    own = {(d, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for (d, _), ids in zip(rows, whole([t for _, t in rows]), strict=True)}
    assert {(r["doc_id"], r["ids_crc32"]) for r in got} == own and len(got) == len(rows)
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 3, 7, 7, 7, 7]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_packing_of_odd_rows(spark):
    rows = [(None, "a b"), (4, None), (4, None), (5, "zz " * 40_000)]
    got = packing.pack_documents(frame(spark, rows), WORDS).collect()
    lengths = [len(x) + 1 for x in whole([t for _, t in rows])]
    assert sum(r["length"] for r in got) == sum(lengths) and sorted(r["length"] for r in got if r["doc_id"] in (None, 4)) == sorted(lengths[:3])
    assert packing.pack_documents(frame(spark, rows).limit(0), WORDS).count() == 0


def test_packing(spark):
    docs, rows = documents(spark)
    got = packing.pack_documents(docs.unionByName(spark.createDataFrame(ODD[:4], "doc_id long, text string")), WORDS).collect()
    rows = rows + ODD[:4]
    ids = {d: x + [0] for (d, _), x in zip(rows, whole([t for _, t in rows]), strict=True)}
    bins: dict = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_bins_are_full():
    draw = random.Random(2)
    for _ in range(20):
        lengths = sorted({draw.randint(1, 30) for _ in range(6)}, reverse=True)
        counts = [draw.randint(1, 3) for _ in lengths]
        room = draw.randint(1, 60)
        sums = {0}
        for x, c in zip(lengths, counts, strict=True):
            sums = {s + k * x for s in sums for k in range(c + 1) if s + k * x <= room}
        chosen = packing.fullest_combination(lengths, counts, room)
        assert sum(lengths[i] * t for i, t in chosen) == max(sums) and all(t <= counts[i] for i, t in chosen)


# pieces


def every_segmentation(model, text):
    """``(score, ids)`` of all segmentations; characters without a piece are their byte pieces."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        piece = model.texts.get(text[:k])
        if piece is not None or k == 1:
            ids = (piece,) if piece is not None else tuple(model.byte_id[b] for b in text[0].encode())
            own = float(model.score[piece]) if piece is not None else model.byte_score
            out += [(own + rest, ids + more) for rest, more in every_segmentation(model, text[k:])]
    return out


def test_n_best_and_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.PieceModel(path)
    texts = ["ab a b", "to in\nthe  an", "it is", "é✓𝔘", "", None, "it is", "x" * 300]
    df = frame(spark, [*enumerate(texts), (None, "it is")])
    encoded = pieces.encode_texts(df, path, 4)
    rows = encoded.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "it is" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        if len(text) < 20:
            every = sorted(every_segmentation(model, "▁" + text.replace(" ", "▁")), key=lambda x: -x[0]) if text else []
            assert r["n_best_scores"] == pytest.approx([x for x, _ in every[:4]]) and r["round_trip"]
            score = {ids: x for x, ids in every}
            found = [tuple(ids) for ids in r["n_best"]]
            assert len(set(found)) == len(found) and [score[x] for x in found] == pytest.approx(r["n_best_scores"])
            assert not text or score[tuple(r["ids"])] == pytest.approx(every[0][0])
    assert {r["doc_id"]: r["text"] for r in pieces.decode_ids(encoded.where("doc_id IS NOT NULL"), path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_texts(df.limit(0), path).count() == 0
    docs, rows = documents(spark)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(pieces.encode_texts(docs, path), path).collect()}
    assert back == dict(rows)


def test_long_chunks_are_solved_alike():
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(4)
    for n in (70, 150):
        text = "".join(draw.choice("abcdeé✓") for _ in range(n))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        best, gap, ids = model._solve_long(points)
        plain = model._solve(points[None])
        assert (best, gap) == pytest.approx((plain[0][0], plain[1][0])) and sum(model.score[i] if i < pieces.AS_BYTES else model.byte_score for i in ids) == pytest.approx(best)
        found = model.search(text, 3)
        assert found[0][0] == pytest.approx(best) and found[1][0] == pytest.approx(best - gap) and len({tuple(x) for _, x in found}) == 3
    for text in ("z" * 200_000, "then" * 25_000):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _, rows, _, starts, ends, padded = model.encode(raw, np.array([0, len(raw)]))
        assert model.decode(ids).tobytes()[1:] == text.encode() and len(model.n_best(rows, starts, ends, padded, ids, 3)) == 3


# models


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.join(labels, "doc_id").where(toxicity.held_out("doc_id")).select("doc_id", "text", "toxic"), model).collect()
    hit = [r["toxic"] for r in scored if r["score"] >= toxicity.THRESHOLD]
    assert sum(hit) / len(hit) > 0.95 and sum(hit) / sum(r["toxic"] for r in scored) > 0.8
    odd = toxicity.score(frame(spark, ODD), model, score_col="SCORE")
    assert odd.columns == [*(c for c in frame(spark, ODD).columns if c != "score"), "SCORE"]
    assert len(odd.collect()) == len(ODD) and all(0 <= r["SCORE"] <= 1 for r in odd.collect())


def test_toxicity_without_evidence(spark):
    docs = frame(spark, [(i, "some words") for i in range(1, 40)])
    for toxic in (0, 1):
        model = toxicity.train(docs, spark.createDataFrame([(i, toxic) for i in range(1, 40)], "doc_id long, toxic int"))
        n = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1, 40))
        assert not model.evidence and model.scores(pa.array(["x", None, ""])) == pytest.approx([(n * toxic + 1) / (n + 2)] * 3)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not none.evidence and none.scores(pa.array(["x", None])).tolist() == [0.5, 0.5]


def plain_grams(text):
    fold = "".join((c.lower() if c.isalnum() else " ") if ord(c) < 128 else c for c in f" {text or ''} ")
    return {fold[i : i + n] for n in toxicity.ORDERS for i in range(len(fold) - n + 1)}


def plain_bucket(gram):
    h = 0
    for k, c in enumerate(gram):
        h = (h + ord(c) * int(toxicity._STEP[len(gram), k])) & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - toxicity.HASH_BITS)


def test_scores_are_sums_over_sets_of_grams():
    texts = ["A bad, BAD day!", None, "", "é É x" * 30, "words and words and words " * 200]
    weights = np.random.default_rng(3).standard_normal(1 << toxicity.HASH_BITS).astype(np.float32) * 0.05
    sums = [sum(float(weights[b]) for b in {plain_bucket(g) for g in plain_grams(t)}) for t in texts]
    got = toxicity.ToxicityModel(weights, -0.5).scores(pa.array(texts))
    assert got == pytest.approx([1 / (1 + math.exp(0.5 - s)) for s in sums], rel=1e-4)


def test_the_fit_is_the_least_loss():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 30, rng.integers(1, 8))).astype(np.uint32), int(rng.random() < 0.4)) for _ in range(60)]
    scale = np.zeros(1 << toxicity.HASH_BITS)
    scale[:30] = rng.standard_normal(30)
    model = toxicity.fit(rows, scale, passes=400, tolerance=1e-9)
    x = np.zeros((60, 31))
    for i, (found, _) in enumerate(rows):
        x[i, found] = scale[found]
    x[:, 30] = math.sqrt(toxicity.BIAS_SQUARE)
    y, w = np.array([1.0 if t else -1.0 for _, t in rows]), np.zeros(31)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-y * (x @ w)))
        w -= np.linalg.solve(toxicity.PENALTY * np.eye(31) + (x.T * (p * (1 - p))) @ x, toxicity.PENALTY * w - x.T @ (y * (1 - p)))
    assert model.bias == pytest.approx(w[30] * x[0, 30], abs=1e-3) and model.weights[:30] == pytest.approx(w[:30] * scale[:30], abs=1e-3)


def test_lm_base_scores(spark):
    _, rows = documents(spark)
    rows = rows[:80] + ODD[:6]
    got = {r["doc_id"]: r for r in lm.score_texts(frame(spark, rows), WORDS).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    tokens = {d: [*brute.words(t), None] for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got[d]
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(want, abs=1e-6) and r["train_tokens"] == total and r["held_out"] == held(d)
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(counts[w] > 0 for w in ws)) and r["score"] < 0
    assert lm.score_texts(frame(spark, rows).limit(0), WORDS).count() == 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    r = lm.lm_query(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.94 * r[1]


def small_model(spark, n=200):
    _, rows = documents(spark)
    packed = frame(spark, rows[:n]).coalesce(1).mapInArrow(lm._pack(WORDS, 4), lm.PACKED).toPandas()
    end = wordtokens.word_tokenizer(WORDS).vocab_size
    counts = np.zeros(end + 1, np.int64)
    for _, r in packed[packed.kind == 5].iterrows():
        counts[np.frombuffer(r.a, "<u4")] += np.frombuffer(r.b, "<u4")
    tokens = packed[packed.kind == 2][["grp", "a", "b", "held"]]
    return tokens, counts, end


def test_lm_learns_from_all_training_windows(spark):
    tokens, counts, end = small_model(spark)
    df = spark.createDataFrame(tokens, "grp long, a binary, b binary, held binary")
    weights, vocabulary = lm.train_model(df, counts)
    start = lm_model.start_weights(vocabulary)
    learnt = set(np.flatnonzero((weights["e0"] != start["e0"]).any(axis=1)).tolist())
    begin = int(vocabulary.inputs[-1])
    seen, total = {begin}, np.zeros_like(counts)
    for _, ids, firsts, training in lm._texts(pa.RecordBatch.from_pandas(tokens, preserve_index=False), end):
        for t in np.flatnonzero(training):
            own = ids[firsts[t] : firsts[t + 1]]
            seen |= set(vocabulary.inputs[own[:-1]].tolist())
            np.add.at(total, own, 1)
    assert len(seen) > 100 and learnt == seen and (total == counts).all()
    # plain Python, an id at a time
    text = np.array([*(int(i) for i in np.argsort(-counts[:-1])[:7]), 123, 45_000] * 9 + [end], np.int32)
    both, firsts = np.concatenate((text, text[-3:])), np.array([0, len(text), len(text) + 3])
    got = lm_model.text_log_probabilities(weights, vocabulary, both, firsts)
    assert got == pytest.approx([plain_log_probability(weights, vocabulary, text), plain_log_probability(weights, vocabulary, text[-3:])], rel=1e-4)


def plain_log_probability(w, v, ids):
    half, head = lm_model.HALF, lm_model.HEAD
    begin = int(v.inputs[-1])
    inputs = [begin, *(int(v.inputs[i]) for i in ids[:-1])]
    z = [sum(w[f"e{k}"][inputs[t - k] if t >= k else begin].astype(float) for k in range(lm_model.RECENT)) for t in range(len(ids))]
    parts = [x @ w["look"].astype(float) for x in z]
    total = 0.0
    for t, i in enumerate(ids):
        first = max(0, t // half - 1) * half  # the block before and the own one
        logits = [float(parts[t][:head] @ parts[j][head : 2 * head]) + float(w["distance"][t - j]) for j in range(first, t + 1)]
        share = [math.exp(min(x, 30)) for x in logits]
        seen = sum(s * parts[j][2 * head :] for s, j in zip(share, range(first, t + 1), strict=True)) / sum(share)
        hidden = z[t] + seen @ w["back"].astype(float)
        leaf = int(v.leaf[i])
        over = [math.exp(float(hidden @ w["part"][p]) + float(w["part_bias"][p])) for p in range(len(w["part_bias"]))]
        total += math.log(over[v.part[leaf]] / sum(over))
        for path, side in zip(v.path, v.side, strict=True):
            if path[leaf] >= 0:
                x = float(hidden @ w["node"][path[leaf]]) + float(w["node_bias"][path[leaf]])
                total -= math.log1p(math.exp(-x if side[leaf] else x))
    return total


def random_vocabulary(rng, n=3000):
    return lm_model.make_vocabulary((rng.pareto(1, n) * 20).astype(np.int64), rng.integers(0, 9, (n, 8)))


def test_the_vocabulary_is_a_distribution():
    rng = np.random.default_rng(0)
    v = random_vocabulary(rng)
    w = {k: x.astype(np.float64) for k, x in lm_model.start_weights(v).items()}
    leaves = np.arange(3000)
    hidden = np.repeat(rng.standard_normal((1, lm_model.WIDTH)) * 3, 3000, axis=0)
    score, _, _ = lm_model._output(w, v, hidden, leaves, False)
    assert np.exp(score).sum() == pytest.approx(1) and sorted(v.leaf) == leaves.tolist()


def test_model_gradients():
    rng = np.random.default_rng(0)
    v = random_vocabulary(rng)
    w = {k: x.astype(np.float64) for k, x in lm_model.start_weights(v).items()}
    w["distance"] += rng.standard_normal(lm_model.WINDOW) * 0.3
    ids = np.minimum(rng.pareto(0.5, 150).astype(np.int64), 2998)
    batch = list(lm_model.batches(v, ids, np.array([0, 70, 150]), step=2))[1]  # begins inside the first text
    assert not batch.counts[: lm_model.HALF].any()
    _, grads = lm_model.gradients(w, v, batch)
    for name, (rows, g) in grads.items():
        at = np.unravel_index(int(np.argmax(np.abs(g))), g.shape)
        cell = at if rows is None else (int(rows[at[0]]), *at[1:])
        step = 1e-5
        w[name][cell] += step
        up = lm_model.gradients(w, v, batch)[0]
        w[name][cell] -= 2 * step
        down = lm_model.gradients(w, v, batch)[0]
        w[name][cell] += step
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-7), name


def test_windows_score_every_position_once():
    lengths = np.array([1, 5, 32, 33, 64, 65, 200, 9000])
    firsts = np.concatenate(([0], np.cumsum(lengths)))
    v = random_vocabulary(np.random.default_rng(2))
    ids = np.random.default_rng(3).integers(0, 3000, firsts[-1])
    seen = []
    for batch in lm_model.batches(v, ids, firsts, step=5):
        seen += list(zip(batch.text[batch.counts].tolist(), batch.target[batch.counts].tolist(), strict=True))
    assert Counter(seen) == Counter((t, int(v.leaf[i])) for t in range(len(lengths)) for i in ids[firsts[t] : firsts[t + 1]])


def test_common_weights_are_means_by_use():
    def row(name, rows, moved, used):
        return (0, name, np.array(rows).tobytes(), np.array(moved, np.float32).tobytes(), np.ones(len(rows), np.float32).tobytes(), np.array(used).tobytes())

    rows = [row("e0", [0, 16], [1.0, 5.0], [1, 2]), row("e0", [0, 32], [4.0, 7.0], [3, 1])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.string(), *[pa.binary()] * 4))], names=list("abcdef"))
    out = next(lm._merge(iter([batch])))
    assert np.frombuffer(out.column(2)[0].as_py(), np.int64).tolist() == [0, 16, 32]
    assert np.frombuffer(out.column(3)[0].as_py(), np.float32).tolist() == pytest.approx([3.25, 5.0, 7.0])


def test_lm_walks_all_levels_of_the_trees_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    v = random_vocabulary(rng)
    w = {k: x.astype(np.float64) for k, x in lm_model.start_weights(v).items()}
    leaves = np.sort(v.leaf[rng.integers(0, len(v.leaf), 500)])
    sums, calls = np.einsum, []
    monkeypatch.setattr(np, "einsum", lambda *a, **k: (calls.append(a[0]), sums(*a, **k))[1])
    for scale in (1, 200):  # the second one has logits beyond 60
        hidden = rng.standard_normal((500, lm_model.WIDTH)) * scale
        calls.clear()
        score, d_hidden, grads = lm_model._output(w, v, hidden, leaves, True)
        assert len(v.path) > 4 and len(calls) <= 3
        logits = np.minimum(hidden @ w["part"].T + w["part_bias"], 60)
        assert (logits.max() == 60) == (scale > 1)
        share = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        want, d_want = np.log(share[np.arange(500), v.part[leaves]]), share @ w["part"] - w["part"][v.part[leaves]]
        d_node = np.zeros_like(w["node"])
        for i, leaf in enumerate(leaves):
            for node, right in zip(v.path[:, leaf], v.side[:, leaf], strict=True):
                if node >= 0:
                    z = np.clip(hidden[i] @ w["node"][node] + w["node_bias"][node], -30, 30)
                    g = 1 / (1 + np.exp(-z)) - right
                    want[i] -= np.log1p(np.exp(-z if right else z))
                    d_want[i] += g * w["node"][node]
                    d_node[node] += g * hidden[i]
        assert score == pytest.approx(want, abs=1e-6) and d_hidden == pytest.approx(d_want, abs=1e-6)
        nodes, got = grads["node"]
        assert len(set(nodes)) == len(nodes) and got == pytest.approx(d_node[nodes], abs=1e-6) and not np.delete(d_node, nodes, axis=0).any()


@pytest.mark.parametrize("kind,width", [(np.float32, 32), (np.float64, 6), (np.float32, 5)])
def test_lm_sums_of_runs(kind, width):
    rng = np.random.default_rng(5)
    rows, first = rng.standard_normal((300, width)).astype(kind), np.unique(np.append(rng.integers(1, 300, 40), 0))
    assert lm_model._sum_runs(rows, first) == pytest.approx(np.stack([x.sum(axis=0) for x in np.split(rows, first[1:])]), abs=1e-4)
    for most in (1000, 1 << 20):
        x = rng.integers(0, most + 1, 500).astype(np.int32)
        assert (lm_model._order(x, most) == np.argsort(x, kind="stable")).all()


def test_lm_looks_no_further_below_a_leaf():
    rng = np.random.default_rng(6)
    v = random_vocabulary(rng)
    looked = []

    class Level(np.ndarray):
        def take(self, *a, **k):
            out = np.ndarray.take(self, *a, **k)
            looked.append(out.size)
            return np.asarray(out)

    leaves = np.sort(v.leaf[rng.integers(0, len(v.leaf), 500)])
    watched = lm_model.Vocabulary(v.inputs, v.leaf, v.part, v.path.view(Level), v.side, v.part_bias, v.node_bias)
    w = lm_model.start_weights(v)
    hidden = rng.standard_normal((500, lm_model.WIDTH)).astype(np.float32)
    lm_model._output(w, watched, hidden, leaves, False)
    # one look a leaf and one at each node: no leaf is looked for below its last node
    assert sum(looked) <= len(leaves) + (v.path[:, leaves] >= 0).sum() < v.path[:, leaves].size
    node, row, right, cuts = lm_model._below(v, leaves)
    level, place = np.nonzero(v.path[:, leaves] >= 0)
    assert (node == v.path[level, leaves[place]]).all() and (row == place).all() and (right == v.side[level, leaves[place]]).all()
    assert cuts == np.searchsorted(level, np.arange(level[-1] + 2)).tolist()
    for lowest in (lm_model._below(v, leaves[:0]), lm_model._below(lm_model.Vocabulary(v.inputs, v.leaf, v.part, v.path[:0], v.side[:0], v.part_bias, v.node_bias[:0]), leaves)):
        assert [len(x) for x in lowest[:3]] == [0, 0, 0]


def test_lm_cuts_only_numbers_that_are_too_large():
    for x in (np.array([1.0, 70.0, np.inf]), np.array([1.0, 59.0]), np.array([np.nan, 70.0]), np.zeros(0)):
        got = x.copy()
        lm_model._at_most(got, 60)
        assert np.array_equal(got, np.minimum(x, 60), equal_nan=True)
