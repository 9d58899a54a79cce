"""Token counts, decontamination, line and span dedup, quality rules, packing: against brute force, SQL and odd rows."""

import hashlib
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF, oracle_rows, same_rows
from vidspark.llm import decontam, lines, packing, quality, queries, spans, tokens
from vidspark.llm._common import clean_scratch, mix, read_table
from vidspark.llm._words import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

LONG = "Some words that go on and on, with a comma. " * 4000
ODD = [
    (1, None, "en", "a", 1), (2, "", None, None, None), (None, "a line without an id, but long enough\nb", "de", "a", 3), (4, "   \n\t \r\n", "en", "a", 1), (5, LONG, "en", "a", 1),
    (5, LONG, "en", "a", 1), (6, "é ß 漢字   x\x1cy <|endoftext|> 'S don't", "xx", "b", 2), (7, "a" * 200_000, "en", "c", 1), (8, "one two three", "en", "c", 1), (9, "ONE two. Three", "en", "c", 1),
    (10, "one good text of a dozen quite different words, which is kept by all", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


CLASHING = ["n_tokens", "n_bytes", "over_limit", "n_words", "n_hit", "items", "contaminated", "n_lines", "n_dropped", "kept_sha256", "n_sentences", "n_removed", "kept", "base_failed", "n_repeat_words", "_id", "_gone", "_text", "_words", "_lang", "paths", "id", "key", "start", "length"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.mark.parametrize(
    "run",
    [
        lambda d, b: tokens.count_tokens(d, BYTE), lambda d, b: decontam.contamination(d, b), lambda d, b: lines.dedup_lines(d), lambda d, b: spans.dedup_spans(d), lambda d, b: quality.quality(d),
        lambda d, b: quality.drop_low_quality(d), lambda d, b: decontam.decontaminate(d, b), lambda d, b: lines.drop_repeated_lines(d), lambda d, b: packing.pack_documents(d, WORD),
    ],
)
def test_odd_rows_empty_tables_and_clashing_columns(spark, odd, empty, run):
    bench = spark.createDataFrame([(1, "one two three"), (None, "x"), (2, None)], "item_id long, text string")
    plain = run(odd, bench)
    n = plain.count()
    assert n > 0
    assert run(clashing(odd), bench).count() == n
    assert run(empty, bench).count() == 0
    assert run(odd, bench.limit(0)).count() >= n


def test_words_equal_the_pattern():
    texts = [t or "" for _, t, *_ in ODD] + ["", "A1b", "-x-", "é", "ÀB c"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)]).astype(np.int64)
    hashes, bounds = word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
    every = [w for t in texts for w in words(t)]
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    known = {}
    for w, h in zip(every, hashes.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 .,\n\té'<|>", max_size=300), st.integers(1, 20))
def test_pieces_are_safe(text, most):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE)
    pieces = tokens.safe_pieces(text, most)
    assert "".join(pieces) == text
    assert sum(len(tokenizer.encode(p, add_special_tokens=False).ids) for p in pieces) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE)
    for df in (odd, read_table(spark, SF, "documents")):
        for r in tokens.count_tokens(df.select("doc_id", "text"), BYTE).collect():
            n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_other_tokenizers_count_whole_texts(spark, odd, name):
    path = public_tokenizers.path(name)
    for r in tokens.count_tokens(odd.filter("doc_id in (5, 8)").select("doc_id", "text"), path).collect():
        assert r.n_tokens == tokens.Lengths(path)._batch([r.text])[0]


@pytest.mark.parametrize("name", ["op2_minhash_dedup", "op3_decontamination", "op5_line_dedup", "op7_substring_dedup", "op9_quality_rules"])
def test_query_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name])


def brute_contamination(docs, items, n):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (s := tuple(w[i : i + k])) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[s]
        out.append((len(w), len(hit), sorted(str(x) for x in found)))
    return out


def brute_longest(text, items, window):
    """Length and first place of the longest stretch of a text that an item holds, of those with a window."""
    best = (0, None)
    for at in range(len(text)):
        for item in items:
            for j in range(len(item)):
                n = 0
                while at + n < len(text) and j + n < len(item) and text[at + n] == item[j + n]:
                    n += 1
                if n >= min(window, len(item)) > 0 and n > best[0]:
                    best = (n, at)
    return best


def test_longest_match_follows_every_item():
    block = decontam.block_of(["A", "B"], ["w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 x", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 y z"], 10)
    hashes, bounds = word_hashes(*decontam.text_buffers(decontam.pa.array(["w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 y z"])))
    found = decontam.search(hashes, bounds, block)[0]
    assert (found.longest, found.longest_at, found.items) == (12, 0, {"A", "B"})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14).map(" ".join), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=9).map(" ".join), min_size=1, max_size=4), st.integers(1, 6), st.integers(1, 12))
def test_suffix_arrays_equal_brute_force(docs, items, window, shard):
    import pyarrow as pa

    block = decontam.block_of(list(range(len(items))), items, window)
    raw, offsets = decontam.text_buffers(pa.array(docs))
    hashes, bounds = word_hashes(raw, offsets)
    found = {}
    for a, b in decontam.shards(bounds, shard):
        found |= {a + k: v for k, v in decontam.search(hashes[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], block).items()}
    for i, (n, n_hit, names) in enumerate(brute_contamination(docs, list(enumerate(items)), window)):
        got = found.get(i)
        assert bounds[i + 1] - bounds[i] == n
        assert sum(b - a for a, b in got.ranges) if got else n_hit == 0
        if got:
            assert sum(b - a for a, b in got.ranges) == n_hit and sorted(got.items) == names
            assert (got.longest, got.longest_at) == brute_longest(words(docs[i]), [words(x) for x in items], window)


def test_suffix_array_of_more_words_than_21_bits():
    n = (1 << 21) + 100
    text = np.random.default_rng(9).permutation(np.arange(1, n + 1, dtype=np.uint64))
    text[-30:] = text[1000:1030]
    array_ = decontam.SuffixArray(text, np.array([0, n]), 10)
    wanted = np.concatenate([text[1000:1010], text[5:8], np.array([text[7], text[5], n + 5], np.uint64)])
    low, high = array_.find(wanted, np.array([0, 0, 0, 0, 10, 12, 10, 15]), np.array([10, 3, 2, 1, 3, 2, 2, 1]))
    assert (high - low).tolist() == [2, 2, 2, 2, 1, 0, 1, 0]
    assert sorted(array_.order[low[0] : high[0]].tolist()) == [1000, n - 30]


def test_benchmark_blocks_agree(spark):
    docs, bench = read_table(spark, SF, "documents").select("doc_id", "text"), read_table(spark, SF, "benchmark")
    keep = ["doc_id", "n_words", "n_hit", "items_sha256", "longest_match"]
    one = decontam.contamination(docs, bench).select(*keep)
    many = decontam.contamination(docs, bench, block_bytes=2000, shard_words=5000).select(*keep)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_line_rules(spark):
    line = "A line of more than twenty characters"
    rows = [(1, f"{line}\nown 1"), (2, f"  {line.upper()}\t\nown 2\n{line}"), (3, f"own 3\n{line}"), (4, "short\nshort"), (5, "short"), (6, "short"), (None, line)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[5].text, got[None].text) == ("own 1", "own 2", f"own 3\n{line}", "short", "")
    assert (got[2].n_lines, got[2].n_dropped) == (3, 2)
    assert got[1].kept_sha256 == hashlib.sha256(b"own 1").hexdigest()


@pytest.mark.parametrize("changed", [{"RANGE_LINES": 100}, {"BITS_A_LINE": 1}, {"MOST_BYTES": 8}, {"FULL": 1.0}])
def test_lines_with_other_filters_are_the_same(spark, monkeypatch, changed):
    docs = read_table(spark, SF, "documents")
    a = sorted((r.doc_id, r.kept_sha256) for r in lines.dedup_lines(docs).collect())
    for name, value in changed.items():
        monkeypatch.setattr(lines, name, value)
    assert a == sorted((r.doc_id, r.kept_sha256) for r in lines.dedup_lines(docs.repartition(7)).collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_filters_have_all_that_is_twice_in_each_range(spark, monkeypatch, parts):
    monkeypatch.setattr(lines, "RANGE_LINES", 300)
    texts = [f"line of text with number {i % 2000 if i % 4 else i}\nand another, whose number is {i}" for i in range(4000)]
    keys = Counter(k for t in texts for k in {x for x in lines.line_keys(t.encode(), 20) if x})
    twice = lines.twice_seen(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts), 2 * len(texts))
    ranges = -(-2 * len(texts) // 300)
    held = dict(zip(keys, lines._suspected([lines._hash(k) for k in keys], twice, ranges).tolist(), strict=True))
    assert len(twice) == ranges and all(held[k] for k, n in keys.items() if n > 1)
    assert sum(held[k] for k, n in keys.items() if n == 1) < 0.06 * sum(n == 1 for n in keys.values())


def test_spans_keep_the_first(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen. Twenty and more."
    rows = [(1, f"Begins here. {passage} Ends a."), (2, f"Other start. {passage.upper()} Ends b."), (3, "Nothing is shared here. At all. No."), (4, f"{passage}\n{passage}")]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    assert got[2].n_removed >= 3 and got[2].text.startswith("Other start.") and got[2].text.endswith("Ends b.")
    assert got[4].n_removed == got[4].n_sentences and got[4].first_doc_id == got[2].first_doc_id == 1 and got[1].first_doc_id is None


@pytest.mark.parametrize("lengths", [(12, 12, 5), (20, 1, 18), (1, 30, 2, 17)])
def test_spans_reach_the_end_of_a_copy(spark, lengths):
    numbers = iter(range(1000))
    copy = " ".join(" ".join(f"w{next(numbers)}" for _ in range(n)) + "." for n in lengths)
    rows = [(1, copy), (2, copy), (3, f"Before it. {copy} After that.")]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].text, got[2].text, got[3].text) == (copy, "", "Before it. After that.")
    assert got[2].n_words_removed == got[3].n_words_removed == sum(lengths)


def test_spans_leave_unique_text_of_rows_that_share_an_id(spark):
    passage = "The first of these lines has some ten words in all. The second of them has as many words in it. And here is a third."
    unique = "Nothing of this is said in any other row of it. Neither is this one which has a few more. Nor this. Nor that. At all."
    rows = [(1, passage), (9, passage), (9, unique), (None, unique + " And more of the same for the nameless."), (None, passage + " With an end."), (None, "Only here. " + unique[:60]), (7, None), (None, None), (None, passage + " With an end.")]
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {(r.doc_id, r.text) for r in got}
    assert len(got) == len(rows)
    # Rows without id come first: theirs is the first passage, and the rest of what they hold is theirs alone.
    assert (1, "") in texts and (9, "") in texts and (9, "") in texts
    assert (None, rows[3][1]) in texts and (None, rows[4][1]) in texts and (None, rows[5][1]) in texts
    got = spans.dedup_spans(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, passage), (9, ""), (9, unique)}


def brute_runs(sizes, min_sentences, min_words):
    """Of the words in each sentence of one text: (first, last) of the shortest long enough run from and to every sentence with words."""
    own = [i for i, n in enumerate(sizes) if n]
    good = {(own[i], own[j]) for i in range(len(own)) for j in range(i + min_sentences - 1, len(own)) if sum(sizes[own[i] : own[j] + 1]) >= min_words}
    return {(a, min(y for x, y in good if x == a)) for a, _ in good} | {(max(x for x, y in good if y == b), b) for _, b in good}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=9), max_size=6), st.integers(1, 3), st.integers(1, 20), st.integers(1, 3))
def test_runs_of_a_batch_are_those_of_its_texts(texts, min_sentences, min_words, kinds):
    row = np.array([i for i, sizes in enumerate(texts) for _ in sizes], np.int64)
    number = [k for sizes in texts for k in range(len(sizes))]
    per_sentence = np.array([n for sizes in texts for n in sizes], np.int64)
    numbers = np.arange(per_sentence.sum(), dtype=np.uint64) % np.uint64(kinds)
    hash_, more, start, end = spans.batch_spans(mix(numbers), per_sentence, row, min_sentences, min_words)
    got = [(int(row[a]), number[a], number[b]) for a, b in zip(start, end, strict=True)]
    assert got == sorted({(i, a, b) for i, sizes in enumerate(texts) for a, b in brute_runs(sizes, min_sentences, min_words)})
    ends = np.cumsum(per_sentence)
    said = [numbers[ends[a] - per_sentence[a] : ends[b]].tobytes() for a, b in zip(start, end, strict=True)]
    # Equal words give equal hashes, others do not, wherever they stand.
    assert len(set(zip(hash_.tolist(), more.tolist(), strict=True))) == len(set(said)) == len(set(zip(hash_.tolist(), more.tolist(), said, strict=True)))


def brute_repeat(w, n=5):
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)})


def test_repeated_windows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 4, 5, 9, 40, 200)] + ["a b c d e f " * 50]
    df = quality.with_repeated_window_words(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("w", quality.words_of(F.col("text"))), "w", "n")
    for r in df.select("text", "n").collect():
        assert r.n == brute_repeat(r.text.split())


def test_quality_plan_is_native(spark, odd):
    for df in (quality.quality(odd), quality.drop_low_quality(odd), quality.measure(odd)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_quality_keeps_clean_and_drops_junk(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    judged = quality.quality(docs, keep_text=False).join(labels, "doc_id")
    clean = judged.filter("quality = 1 and not base_failed")
    assert clean.filter("not kept").count() == 0
    assert judged.filter("quality = 0 and not kept").count() > 0.7 * judged.filter("quality = 0").count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing(lengths):
    window = 64
    bins, offsets = packing.best_fit_decreasing(np.array(lengths, np.int64), window)
    spans_ = {}
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths, strict=True):
        spans_.setdefault(b, []).append((o, n))
    for parts in spans_.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    room, brute = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(window - n)
            brute += 1
    assert len(spans_) == brute


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBé.,!'<|>s1 \n\t\x1ćßİ-_endoftx", max_size=60), max_size=6))
def test_word_ids_equal_the_library(texts):
    ids = packing._encoder(WORD)
    assert isinstance(ids, packing.WordIds)
    assert ids(texts) == packing.TextIds.__call__(ids, texts)


def test_packing_places_every_id_once(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame([(None, None), (None, ""), (7, "x"), (10**6, LONG)], "doc_id long, text string"))
    pieces = packing.pack_documents(docs, WORD, group=50).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    want = Counter()
    for r in docs.collect():
        ids = array("I", [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
        for s in range(0, len(ids), 2048):
            want[(r.doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    assert want == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert 2048 * len(by) < 1.1 * sum(r.length for r in pieces) + 2048 * 12
    sequences = packing.sequences(docs, WORD, group=50)
    assert sequences.count() == len(by) and sequences.filter(F.size("ids") != 2048).count() == 0


def test_scratch_can_be_cleaned(spark):
    lines.dedup_lines(read_table(spark, SF, "documents")).count()
    clean_scratch(spark)
    from vidspark.llm import _common

    assert not _common._written


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = read_table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before
        if name == "quality rules":
            _, rows = oracle_rows(queries.OP9_SQL)
            assert after == {r[0] for r in rows if r[-1]}
        if name == "line dedup":
            assert after == before
    bench = read_table(spark, SF, "benchmark").collect()
    left = kept.collect()
    assert all(hit == 0 for _, hit, _ in brute_contamination([r.text for r in left], [(r.item_id, r.text) for r in bench], 10))
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in left}


def test_pipeline_takes_odd_documents(spark, odd, empty, monkeypatch):
    import corpus_pipeline

    rows = [(20, "A fine text of some length that has every right to stay in the corpus, as it says nothing twice and is in plain words.", "en", "a", 1), (20, "Another row that has the same number but other words, which it keeps to the end of the whole pipeline as is right.", None, None, None)]
    docs = clashing(odd.union(spark.createDataFrame([*rows, *rows, (None, rows[0][1], "en", "a", 1)], SCHEMA)))
    for frame in (docs, clashing(empty)):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF).cache()
            assert kept.columns == frame.columns
        assert len({(r.doc_id, r.text) for r in kept.collect()} & {(20, rows[0][1]), (20, rows[1][1]), (None, rows[0][1])}) == (3 if frame is docs else 0)
        assert (corpus_pipeline.pack(spark, kept, SF).count() > 0) == (frame is docs)


def test_pipeline_drops_what_it_no_longer_needs(spark):
    import corpus_pipeline
    from vidspark.llm import _common

    before = _common.scratch_mark()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert _common.scratch_mark() - before == 2  # what packing reads
