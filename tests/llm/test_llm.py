"""The training-data operators against brute force, and their edge cases."""

import dataclasses
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import common, components, decontam, langid, lines, mixing, nearcopies, pages, simhash, substring, suffixes, tokens, topk

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, size int, row string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    full = [(i, t, lang, s, None if t is None else len(t), 1, 2, "x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Short documents with shared passages, copies, ties, nulls, empty and long ones."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = say(70), say(9000)
    out = [None, "", "  \n\t", "a", "a " * 400, long, long + " end", passage]
    for i in range(40):
        out.append("\n".join([say(rng.randint(1, 60)), passage if i % 3 == 0 else say(20), say(rng.randint(0, 40))]))
    out += [out[9], out[9], out[10].replace(" ", "  ", 3), out[11] + "!"]
    return [(i, t, ("en", "de", None)[i % 3], ("s2", "s1", None, "s10")[i * i % 4]) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_repeats(texts, units, join, window=50):
    seen, out = {}, []
    for i, t, *_ in texts:
        u = units((t or "").encode())
        dead = [False] * len(u)
        for k in range(len(u) - window + 1):
            x = join(u[k : k + window])
            if seen.get(x, i) < i:
                dead[k : k + window] = [True] * window
            else:
                seen[x] = i
        spans = sum(d and not (k and dead[k - 1]) for k, d in enumerate(dead))
        out.append((i, len(u), sum(dead), spans, join([a for a, d in zip(u, dead) if not d])))
    return out


@pytest.mark.parametrize("hot", [2, 64])
def test_suffix_dedup(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "METHOD", dataclasses.replace(suffixes.METHOD, hot=hot))
    assert rows_of(suffixes.remove_repeats(docs)) == sorted(brute_repeats(texts, list, bytes), key=repr)


@pytest.mark.parametrize("hot", [2, 2000])
def test_substring_dedup(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(substring, "METHOD", dataclasses.replace(substring.METHOD, hot=hot))
    want = [(i, n, gone, kept.decode()) for i, n, gone, _, kept in brute_repeats(texts, WORD.findall, b" ".join)]
    assert rows_of(substring.remove_repeats(docs)) == sorted(want, key=repr)


@pytest.mark.parametrize("method", [substring, suffixes])
def test_repeats_among_rows_without_ids(spark, method, monkeypatch):
    """Rows of one id never remove from each other, however many there are; each is matched by its own anchors."""
    monkeypatch.setattr(method, "METHOD", dataclasses.replace(method.METHOD, hot=8))
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = say(60), say(70)
    rows = [(None, f"{say(5)} {passage} {say(9)}", None, None) for _ in range(30)] + [(4, f"{say(9)} {other}", None, None)] * 3
    rows += [(4, f"{other} {say(3)}", None, None), (7, f"{say(4)} {passage} {other}", None, None), (8, say(90), None, None)]
    texts = [(-1 if i is None else i, t) for i, t, *_ in rows]
    units, join = (WORD.findall, b" ".join) if method is substring else (list, bytes)
    want = [(None if i < 0 else i, n, gone) for i, n, gone, *_ in brute_repeats(texts, units, join)]
    got = method.remove_repeats(documents(spark, rows).repartition(3))
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert max(gone for *_, gone in want) >= 130


def test_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(60):
        parts = [[rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.choice([0, 1, 7, 40]))] + [0] for _ in range(4)]
        bounds = np.cumsum([0] + [len(p) for p in parts])
        got = suffixes.suffix_arrays(np.array(sum(parts, []), np.int64), bounds)
        for i, p in enumerate(parts):
            assert (got[bounds[i] : bounds[i + 1]] - bounds[i]).tolist() == sorted(range(len(p)), key=lambda k: p[k:])


def test_line_dedup(docs, texts):
    more = texts + [(100 + k, t, None, None) for k, t in enumerate(["a\nb\nc\nd", "x\na\nb\nc\ny\nb\nc\nd", "a\nb\nx", "q\nq\nq\nq\nq"])]
    seen, want = {}, []
    for i, t, *_ in more:
        rows = t.split("\n") if t is not None else []
        dead = set()
        for k in range(len(rows) - 2):
            if seen.setdefault(tuple(rows[k : k + 3]), (i, k)) != (i, k):
                dead |= {k, k + 1, k + 2}
        for k, line in enumerate(rows):
            if len(line.encode()) >= 60 and seen.setdefault(line, (i, k)) != (i, k):
                dead.add(k)
        kept = None if t is None else "\n".join(r for k, r in enumerate(rows) if k not in dead)
        want.append((i, kept, len(rows), len(dead)))
    got = lines.dedup_lines(documents(docs.sparkSession, more))
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert rows_of(got.select("doc_id", "text", "n_lines", "n_removed")) == sorted(want, key=repr)


def brute_print(text):
    words = WORD.findall((text or "").encode().translate(simhash._LOWER))
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64(b" ".join(words[k : k + size]), seed=42).intdigest() for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts):
    prints = {i: brute_print(t) for i, t, *_ in texts}
    group = {i: i for i in prints}
    for i in prints:  # smallest id reachable, by repeated relaxation
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                low = min(group[i], group[j])
                group = {k: low if g in (group[i], group[j]) else g for k, g in group.items()}
    assert rows_of(simhash.near_duplicates(docs)) == sorted(((i, f"{p:016x}", group[i]) for i, p in prints.items()), key=repr)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(group.values())


def test_golay_links_lose_nothing(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        prints |= {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(3)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")))
    got = {r.node: r.root for r in roots.collect()}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert got.get(a, a) == got.get(b, b)
    assert len({got.get(a, a) for a in signed}) == 40


def test_near_copies(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in [rng.randrange(60, 400) for _ in range(60)]:
        words = say(n)
        rows.append(words)
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randint(1, 1 + n // 40)):
                copy[rng.randrange(n)] = "other"
            rows.append(copy)
    base = say(80)
    rows += [[*base[:k], f"n{k}", *base[k + 1 :]] for k in range(60)]  # more than the leaders of a band
    rng.shuffle(rows)
    sets_of = [{tuple(r[k : k + 5]) for k in range(len(r) - 4)} for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets_of):
        for j in range(i):
            if group[i] != group[j] and len(a & sets_of[j]) >= 0.8 * len(a | sets_of[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    df = documents(spark, [(i, " ".join(r), "en", "s") for i, r in enumerate(rows)] + [(900, None, None, None), (901, "", None, None)])
    assert 60 < len(set(group)) < 200
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(group) | {900}


def test_near_copies_among_texts_with_a_common_half(spark):
    """Pairs at 0.825 among many texts that share so much that they are at 0.776 to each other: every pair is found."""
    rng = random.Random(10)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = say(350)
    rows = []
    for k in range(80):
        own = say(50)
        rows += [(2 * k, " ".join(common + own), "en", "s"), (2 * k + 1, " ".join(common + own[:13] + say(37)), "en", "s")]
    sets_of = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, *_ in rows]
    like = lambda a, b: len(sets_of[a] & sets_of[b]) / len(sets_of[a] | sets_of[b])
    assert like(0, 1) > 0.8 > like(0, 2)
    kept = nearcopies.keep_first(documents(spark, rows).withColumn("a.b", F.lit(1)))
    assert {r.doc_id for r in kept.collect()} == {2 * k for k in range(80)} and "a.b" in kept.columns


def test_near_dedup_links_by_fingerprints(spark):
    """Texts that differ in white space, case or a word of many are found by SimHash, before any prefix is looked up."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(1, " ".join(words), "en", "s"), (2, " ".join([*words[:-1], "other"]), "en", "s"), (3, " ".join(words[::-1]), "en", "s")]
    df = documents(spark, rows)
    signed = nearcopies.prints(df, 5, 0.8, bytes(1 << nearcopies.BITS - 3))
    by_id = {r.key: r for r in signed.collect()}
    for i, text, *_ in rows:
        hashes = [xxhash.xxh64_intdigest(" ".join(text.split()[k : k + 5]), 42) for k in range(2996)]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 2996)
        assert by_id[i].fingerprint & (1 << 64) - 1 == want
    assert (by_id[1].fingerprint ^ by_id[2].fingerprint).bit_count() <= 2
    pairs = {frozenset((r.a, r.b)) for r in nearcopies.print_pairs(signed).collect()}
    assert pairs == {frozenset((by_id[1].node, by_id[2].node))}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {1, 3}


def join_rows(plan):
    """Rows that the joins of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return join_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return join_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(join_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_near_copies_around_one_text(spark):
    """Texts that are near copies of one, but not of each other, meet it first; pairs of many lists are made once."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [base] + [[*base[: 9 * k], *[f"n{k}x{i}" for i in range(20)], *base[9 * k + 20 :]] for k in range(40)]
    df = documents(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    signed = nearcopies.prints(df, 5, 0.8, nearcopies.frequent_shingles(df, 5, 0.8)).cache()
    met, none = nearcopies.lists(signed).cache(), spark.createDataFrame([], "node long, root long")
    assert met.where(f"size > {nearcopies.LIST}").count() > 1000
    pairs = nearcopies.possible(nearcopies.first_pairs(met, none, 0.8), signed, 0.8)
    roots = components.components(nearcopies.verified(df, signed, pairs, 5, 0.8))
    assert roots.count() == 41 and roots.select("root").distinct().count() == 1
    more = nearcopies.further_pairs(met, signed, none, 0.8)
    made = len(more.collect())
    assert 41 * 40 / 4 < made <= join_rows(more._jdf.queryExecution().executedPlan()) <= 1.2 * made
    assert nearcopies.further_pairs(met, signed, roots, 0.8).isEmpty()
    assert [r.doc_id for r in nearcopies.keep_first(df).collect()] == [0]


def test_near_copies_of_no_rows(spark):
    assert nearcopies.keep_first(documents(spark, [])).collect() == []


def test_null_and_repeated_ids_keep_their_texts(spark):
    say = lambda k: " ".join(f"word{k}x{i}" for i in range(80))
    rows = [(None, say(k), "en", "s") for k in range(4)] + [(3, say(k), "en", "s") for k in range(3, 7)] + [(3, say(5), "en", "s")]
    for keep in (simhash.keep_first, nearcopies.keep_first):
        kept = keep(documents(spark, rows))
        assert sorted(r.text for r in kept.collect()) == sorted(say(k) for k in range(7))
        assert kept.where("doc_id IS NULL").count() == 4


def test_languages_of_rows_without_ids(spark):
    rows = [(None, "der die und den", "de", None)] * 300 + [(None, "the of and to", "en", None)] * 300
    model = langid.learn(documents(spark, rows))
    assert {k: v.split() for k, v in model.items()} == {"de": b"der die und den".split(), "en": b"the of and to".split()}


def test_components_of_a_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (5, 5)], "a long, b long"))
    assert {r.root for r in components.components(edges).collect()} == {0, 100}


def test_language(spark):
    rng = random.Random(4)
    en, de = ("the of and to in that was his with for".split(), "der die und den von zu das mit sich des".split())
    rows = []
    for i in range(120):
        words = (en, de)[i % 2]
        rows.append((i, " ".join(rng.choice(words) + rng.choice(["", "ing" if i % 2 == 0 else "ung"]) for _ in range(60)), ("en", "de")[i % 2], None))
    rows += [(200, None, "en", None), (201, "", None, None), (202, "12 34 !", "de", None), (203, rows[0][1].upper(), None, None)]
    got = {r.doc_id: r for r in langid.language_report(documents(spark, rows)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows[:120]) >= 118
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.identify(documents(spark, rows), {"en": b"the of", "de": b"der die"}, margin=0.0)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and {r.doc_id for r in kept.collect()} == set(range(120)) | {203}
    assert {r.lang_pred for r in langid.language_report(documents(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def test_decontamination(spark):
    items = [
        (1, "Yesterday the baker Alice sold 12 loaves and 30 kg of flour, so the baker Bob bought 12 rolls"),
        (2, "short but sweet"),
        (3, None),
        (4, ""),
        (5, "one two three four five six seven eight nine ten eleven twelve"),
    ]
    rows = [
        (1, "x y. Yesterday the baker Carol sold 7 loaves and 45 kg of flour, so the baker Dan bought 7 rolls. z", None, None),
        (2, "Yesterday the baker Carol sold 7 loaves and 45 kg of flour, so the baker Dan bought 8 rolls", None, None),
        (3, "how short but sweet it is", None, None),
        (4, "one two three four five six seven eight nine then other words", None, None),
        (5, "one two three four five six seven eight", None, None),
        (6, None, None, None),
        (7, "", None, None),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 0):
        got = rows_of(decontam.leak_report(documents(spark, rows), bench, broadcast_windows=most))
        assert [(r[0], r[1]) for r in got] == [(1, 1), (3, 2)]
    assert decontam.leak_report(documents(spark, rows), bench, share=0.3).where("doc_id = 4 AND item_id = 5").count() == 1
    kept = decontam.drop_leaks(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7]
    assert decontam.drop_leaks(documents(spark, rows), bench.limit(0)).count() == 7


def test_partial_leaks(spark, tmp_path):
    items = [
        (1, "Alice has 5 apples. Bob buys 3."),
        (2, "A train needs 3 hours for the first part and 5 hours for the second part of its way, then 12 more stops and 12 signs wait behind the bridge over the river"),
    ]
    rows = [
        (1, "Carol has 7 apples. Dan buys 4.", None, None),  # names open sentences
        (2, items[0][1].lower(), None, None),
        (3, items[1][1].replace("12 signs", "13 signs"), None, None),  # one value contradicts another
        (4, items[1][1].replace("3 hours", "4 hours").replace("5 hours", "4 hours"), None, None),  # two values become one
        (5, "The old market sells apples and pears, and a bridge leads over the river behind it", None, None),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.partial_leaks(documents(spark, rows), bench)
    assert rows_of(found.select("key", "item_id")) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, documents(spark, rows), str(tmp_path)).collect()] == [5]


def test_mixture(docs, texts):
    size = {i: len(WORD.findall((t or "").encode())) for i, t, *_ in texts}
    total = {}
    for i, _, _, s in texts:
        total[s] = total.get(s, 0) + size[i]
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        target |= {s: 2 * total[s] if over else level * weight[s] for s in over or free}
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= set(over)
    got = mixing.mix_sizes(docs).collect()
    source, taken = {i: s for i, _, _, s in texts}, {}
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 64 for s in order)
    assert rows_of(mixing.mix_sizes(docs)) == sorted(map(tuple, got), key=repr)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text.encode()))
    assert words == {r.doc_id: r.taken for r in got if r.taken}


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(9)).alias("p"))
        assert sorted(r.p for r in got.collect()) == list(range(n))


def test_tokens(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = texts + [(300, "It's  DON'T <|endoftext|> naïve ÀÉ ¼ \x85x\xa0y", None, None), (301, "日本 ΟΔΟΣ é \x1c z", None, None), (301, "again", None, None)]
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    keyed = sorted(odd[:-2]) + sorted(odd[-2:], key=lambda r: xxhash.xxh64(r[1].encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(r[1].encode(), seed=42).intdigest() >> 63))
    for i, t, *_ in keyed:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(tokens.token_table(documents(docs.sparkSession, odd), path)) == sorted(want, key=repr)


def test_word_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(8)
    bits = ["don't", "DON'T", "'s", "\"'s", "<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "Él", "İstanbul", "ΣΑΣ", "x\x1cy", "\x00", "a\x00", "ab\x00"]
    bits += ["naïve", "\u0301", "日本語", "1234", "a1b2", "--", "_a_", "\x85", "\xa0x", "\u2003", "\x7f", "q" * 40, "Q" * 17, "é" * 20, "😀", "<", "'", "abcdefgh", "abcdefghabcdefgh"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "\t\t", "\x0b"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    encode = tokens.word_encoder(path, most=50)
    for some in (texts[:200], texts[200:], ["", None, " "], []):
        ids, lengths = encode(pa.array(some, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])][: len(some)] == want


def test_word_encoder_keeps_words_met_again(monkeypatch):
    """Of more words than it remembers, those that came again are not encoded anew."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(11)
    often = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)] + ["Ünder", "don't"]
    given = []

    class Noted:
        def __init__(self, real):
            object.__setattr__(self, "real", real)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def __setattr__(self, name, value):
            setattr(self.real, name, value)

        def encode_batch_fast(self, texts, **more):
            given.extend(w for t in texts for w in t.split())
            return self.real.encode_batch_fast(texts, **more)

    noted = type("NotedTokenizer", (), {"from_file": staticmethod(lambda p: Noted(Tokenizer.from_file(p)))})
    monkeypatch.setattr("tokenizers.Tokenizer", noted)
    encode = tokens.word_encoder(path, most=200)
    for _ in range(12):
        once = ["".join(rng.choice("ijklmnop") for _ in range(12)) for _ in range(60)]
        text = " ".join(often + once)
        assert encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert all(given.count(w) == 1 for w in often[:40]) and len(given) >= 12 * 60 + 40


def test_token_blocks():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0), np.zeros(5000), rng.integers(0, 131072, 3000), rng.geometric(0.01, 70000) % 500):
        block = tokens.write_block(np.array([4, -7]), np.array([1, max(0, len(ids) - 1)]), ids.astype(np.uint32))
        assert np.array_equal(tokens.read_block(block)[2], ids)
    with pytest.raises(ValueError):
        tokens.read_block(block[:-40] + bytes([block[-40] ^ 1]) + block[-39:])


def test_topk(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(9)]
    rows += [(300, None), (301, [1.0, None, 0, 0, 0, 0]), (302, [float("nan")] * 6), (350, [1.0, 2.0]), (None, rows[1][1])]
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    ok = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    want = []
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("r", F.lit(1))
    assert rows_of(topk.nearest(df)) == sorted(want, key=repr)
    vectors = topk.quantised(df)
    assert rows_of(topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), row_block=20, query_block=2)) == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav>Home</nav></body></html>", ""),
        ("<nav><a>Home</a></nav><div class='ad'>Buy, now.</div><article><h1>T &amp; U</h1><p><b>One<br><p>Two  <i>th</i>ree</article><footer>&copy; x</footer>", "T & U One Two three"),
        ("<main><p>Body text, long.</p><aside>no</aside><form>no</form><section id='comments'><p>no</p></section><script>var t='</p>';</script></main>", "Body text, long."),
        ("<div class='cookie-notice'>We use cookies.</div><div id=c><p>" + "A long sentence, with marks. " * 9 + "</p><p>More of it, here.</p></div><ul><li><a>x</a></li><li><a>y</a></li></ul>", ("A long sentence, with marks. " * 9 + "More of it, here.")),
        ("<article><p>cut short <b", "cut short"),
        ("<article>a<!-- no --> b<!-- never closed", "a b"),
    ],
)
def test_pages(page, text):
    assert pages.main_text(page) == text


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<article>a b</article>", 5), (2, None, None, 6)], "page_id long, url string, html string, text int")
    assert rows_of(pages.extract(df)) == [(1, "u", "a b", 3), (2, None, "", 0)]


def test_empty_tables(spark):
    none = documents(spark, [(1, "a", "en", "s")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        lines.dedup_lines(none), langid.language_report(none), decontam.leak_report(none, bench), simhash.near_duplicates(none), simhash.keep_first(none),
        tokens.token_table(none, public_tokenizers.path("word_bpe_49k.json")), substring.remove_repeats(none), suffixes.remove_repeats(none), topk.nearest(vectors), mixing.mix_sizes(none), mixing.mix_documents(none),
    ):
        assert df.count() == 0


def test_null_ids(spark):
    say = " ".join(f"word{i}" for i in range(80))
    df = documents(spark, [(None, say, "en", "s"), (3, say, "en", "s"), (3, say, "en", "s")])
    assert [(r.doc_id, r.n_removed) for r in sorted(substring.remove_repeats(df).collect(), key=repr)] == [(3, 80), (3, 80), (None, 0)]
    assert sorted(r.n_spans for r in suffixes.remove_repeats(df).collect()) == [0, 1, 1]
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(None, None), (3, None)}
    assert simhash.keep_first(df).count() == 1 and mixing.mix_sizes(df).count() == 3


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("the of and to in that was his with for".split()) + rng.choice(["a", "e", "ing", "er"]) for _ in range(n))
    rows = [(i, say(80), "en", ("a", "b")[i % 2]) for i in range(30)]
    rows += [(40, rows[3][1], "en", "a"), (41, None, None, "b"), (42, "1 2 3", "en", "b")]
    leak = say(25)
    rows.append((43, f"{say(40)} {leak} {say(40)}", "en", "a"))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] == {*range(30), 40, 43} and kept[1] == kept[0] - {40} and kept[2] == kept[1] - {43} and kept[3] <= kept[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_texts_are_worked_on_in_small_batches():
    texts = ["a" * 40, None, "é" * 30, "", "b" * 500, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["key", "text"])
    some = list(common.small_batches([batch, batch.slice(0, 0), batch.slice(3)], "text", 100))
    assert [b.column("key").to_pylist() for b in some] == [[0, 1, 2, 3], [4], [5], [3], [4], [5]]
    assert [t for b in some[:3] for t in b.column("text").to_pylist()] == texts


def test_pieces_that_share_an_anchor_but_no_window(spark):
    rng = random.Random(5)
    shared = rng.randbytes(24).hex()[: suffixes.WINDOW - 1]
    texts = [f"{rng.randbytes(40).hex()}{shared}{rng.randbytes(40).hex()}" for _ in range(2)]
    for found in suffixes._compare([t.encode() for t in texts], np.array([1, 2]), np.array([0, 0])):
        assert len(found) == 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.remove_repeats(docs).orderBy("doc_id").collect()
    assert [(r.n_removed, bytes(r.kept).decode()) for r in got] == [(0, t) for t in texts]
