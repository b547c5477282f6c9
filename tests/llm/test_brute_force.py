"""Operators against brute force, public libraries and held-out labels."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, license_scan, maxscore, ngram_join, packing, piece_codec, quality, substring, token_counts, toxicity
from tessera.llm.common import cut, documents, hash_runs, windows


@pytest.fixture(scope="module")
def docs(spark, small):
    return documents(spark, small)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def tokens(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


# --- hashing ---------------------------------------------------------------------------------


def test_equal_runs_hash_alike_and_others_do_not():
    words = [b"a", b"abcdefgh", b"abcdefghi", b"abcdefgh" * 9, b"a"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    start = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    h = hash_runs(data, start, start + [len(w) for w in words])
    assert h[0] == h[4] and len(set(h.tolist())) == 4


def test_windows_depend_on_content_alone():
    h = np.arange(50, dtype=np.uint64)
    w = windows(np.concatenate((h, h)), 7)
    assert (w[:44] == w[50:94]).all() and len(set(w[:44].tolist())) == 44


# --- 1: search -------------------------------------------------------------------------------


def test_search_equals_scoring_everything(spark, docs, texts, small):
    queries = documents(spark, small, "benchmark")
    held = {i: collections.Counter(tokens(t)) for i, t in texts.items()}
    df = collections.Counter(w for c in held.values() for w in c)
    n, average = len(held), sum(sum(c.values()) for c in held.values()) / len(held)
    size = {i: sum(c.values()) for i, c in held.items()}
    idf = {w: np.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    want = {}
    for r in queries.collect():
        score = {}
        for w in set(tokens(r.text)):
            for i, c in held.items():
                if c[w]:
                    score[i] = score.get(i, 0) + int(1000.0 * idf[w] * (c[w] * 2.2) / (c[w] + 1.2 * (1 - 0.75 + 0.75 * size[i] / average)))
        best = sorted(((-s, i) for i, s in score.items() if s), key=lambda x: x)[:10]
        want[r.item_id] = [(i, -s) for s, i in best]
    got = collections.defaultdict(list)
    for r in maxscore.top_k(docs, queries).orderBy("rank").collect():
        got[r.item_id].append((r.doc_id, r.score))
    assert got == want


def test_small_shards_give_the_same(monkeypatch):
    draw = random.Random(4)
    term = np.array([draw.randrange(12) for _ in range(3000)])
    doc = np.array([draw.randrange(400) for _ in range(3000)])
    doc, term = np.unique(np.stack((doc, term)), axis=1)
    impact = np.array([draw.randrange(1, 60) for _ in term])
    for query in (np.arange(12), np.array([1, 3]), np.array([5])):
        total = np.zeros(400, np.int64)
        inside = np.isin(term, query)
        np.add.at(total, doc[inside], impact[inside])
        want = sorted((-s, i) for i, s in enumerate(total.tolist()) if s)[:10]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for lo in range(0, 400, 37):
            here = (doc >= lo) & (doc < lo + 37)
            best = maxscore.Shard(np.arange(lo, min(400, lo + 37)), doc[here] - lo, term[here], impact[here], 12).search(query, best, 10)
        assert [(-s, i) for s, i in zip(best[0].tolist(), best[1].tolist())] == want


# --- 2: toxicity -----------------------------------------------------------------------------


def by_hand(symbols, quoted):
    """The grammar's score of a clause, written out without transducers."""
    T = toxicity
    total, denied, near, deed, said, open_ = 0.0, False, 0, 0, False, quoted
    for x in symbols:
        score = 0.0
        if x in (T.GAP, T.BREAK):
            denied, near, deed = False, 0, 0
        elif x == T.CONTRAST:
            denied = False
        elif x == T.NEGATION:
            denied = True
        elif x == T.REPORT:
            said = True
        elif x in (T.TARGET, T.OBJECT):
            score = 0.5 * (near == 2) + {2: 1.5, 3: 0.75}.get(deed, 0)
            near = 1
            if x == T.OBJECT:
                deed = 7 if deed in (1, 5, 7) else 6
            else:
                deed = deed if deed in (1, 5, 7) else 4
        elif x == T.INTENT:
            deed = {4: 5, 5: 5, 6: 7, 7: 7}.get(deed, 1)
        elif x == T.QUOTE:
            open_ = not open_
        elif denied:
            pass
        elif x == T.INSULT:
            score = 0.5 + 0.5 * (near == 1)
            near = near or 2
        elif x == T.THREAT:
            score = 1.5 * (deed == 7)
            deed = {1: 2, 5: 2, 7: 0}.get(deed, 3)
        elif x == T.WISH:
            score = 1.5 * (deed in (5, 7))
            deed = 0
        total += score * (0.25 if open_ and not said else 1)
    return total * (0.25 if said else 1)


def test_composed_table_equals_the_rules_by_hand():
    draw = random.Random(2)
    clauses = [[draw.randrange(1, toxicity.DENIED) for _ in range(draw.randrange(0, 14))] for _ in range(4000)]
    quoted = np.array([draw.random() < 0.2 for _ in clauses])
    symbol = np.array([x for c in clauses for x in c])
    clause = np.repeat(np.arange(len(clauses)), [len(c) for c in clauses])
    got = toxicity.score_clauses(symbol, clause, len(clauses), quoted)
    assert np.allclose(got, [by_hand(c, q) for c, q in zip(clauses, quoted)])


def test_clauses_and_their_symbols():
    T = toxicity
    text = T.plain(pa.array(["You, moron! One two three four five idiot, “he is a fool. No idiot” but", "", 'Das ist kein Idiot. a "b idiot']))
    c = T.clause_symbols(text)
    got = [c.symbol[c.clause == k].tolist() for k in range(len(c.of))]
    assert got == [[T.TARGET, T.BREAK, T.INSULT], [T.GAP, T.INSULT, T.BREAK, T.QUOTE, T.TARGET], [T.NEGATION, T.INSULT, T.QUOTE, T.CONTRAST], [T.NEGATION, T.INSULT], [T.INSULT]]
    assert c.of.tolist() == [0, 0, 0, 2, 2] and c.quoted.tolist() == [False, False, True, False, False]
    assert c.before.tolist() == [0, 2, 12, 15, 19]


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("You are a stupid idiot.", True),
        ("YOU ARE A STUPID IDIOT!!", True),
        ("I will kill you.", True),
        ("You should die!", True),
        ("What a moron. Pathetic clown.", True),
        ("He is not an idiot, and she is no moron.", False),
        ("She said you are a stupid idiot.", False),
        ("“You are a moron,” he wrote.", False),
        ("Take out the trash.", False),
        ("The process will kill the task.", False),
        ("They never said anything stupid.", False),
        ('token = "0b96" you stupid idiot moron', True),
        ("You are not stupid but a moron.", True),
        ("“You are a moron. You are an idiot.” That was all.", False),
        ('A 5" nail, and you are a moron.', True),
        ("Ich werde dich umbringen.", True),
        ("Du bist kein Idiot.", False),
        ("Du bist ein Idiot.", True),
        ("Die Leute sollen die Stadt sehen.", False),
        ("Tu es un imbécile.", True),
        ("Je vais te tuer.", True),
        ("Je ne vais pas te tuer.", False),
        ("Eres un idiota.", True),
        ("Te voy a matar.", True),
        ("The clown" + " laughed and danced" * 700 + ". The trash was full.", False),
    ],
)
def test_toxic_sentences(text, toxic):
    assert toxicity.score_texts(pa.array([text]))[2].tolist() == [toxic]


CALM = "The day was calm and nothing came of it. "


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("I will kill you. " + CALM * 200, True),
        (CALM * 1000 + "I will kill you. " + CALM * 1000, True),
        (CALM * 2000 + "You are a moron.", True),
        ((CALM * 180 + "I will kill you. ") * 10, True),
        ("Kill them. " + CALM * 400 + "Kill them.", True),
        (CALM * 400 + "What a moron. A clown. " + CALM * 400, True),
        ("A clown. " + CALM * 400 + "The trash.", False),
        ("La ville est vile. Une vile affaire. Que la vie est vile.", False),
        ("You are a vile naïve person.", True),
    ],
)
def test_length_does_not_decide(text, toxic):
    assert toxicity.score_texts(pa.array(["x", text, "A clown."]))[2].tolist() == [False, toxic, False]


@pytest.mark.parametrize("text", ["You are a _moron_ and I will _kill_ you.", "_You_ _idiot_", "you\nMORON\nyou", "“you moron”", "you __moron"])
def test_screen_reads_what_the_grammar_knows(text):
    assert toxicity.score_texts(pa.array([text]))[0][0] > 0


def test_labelled_documents(docs, spark, small):
    labels = documents(spark, small, "labels").where("toxic = 0").select("doc_id")
    assert toxicity.toxic_documents(docs).join(labels, "doc_id").count() == 0
    assert toxicity.toxic_documents(docs).count() > 5


def test_held_out_recall_by_language(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = documents(spark, folder), documents(spark, folder, "labels")
    learned = toxicity.learned_insults(docs, labels.where("doc_id % 3 <> 0"))
    tested = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").withColumn("found", toxicity.toxicity_of("text", learned)["toxic"])
    rows = tested.groupBy("lang").agg(*(F.count_if(c).alias(n) for c, n in ((F.expr("toxic = 1"), "toxic"), (F.expr("toxic = 1 and found"), "hit"), (F.expr("toxic = 0"), "clean"), (F.expr("toxic = 0 and found"), "alarm")))).collect()
    by = {r.lang: r for r in rows}
    assert sum(r.alarm for r in rows) <= 0.01 * sum(r.clean for r in rows)
    assert sum(r.hit for r in rows) >= 0.8 * sum(r.toxic for r in rows)
    assert all(by[x].hit >= 0.8 * by[x].toxic for x in ("en", "de", "fr"))  # es has 21 toxic rows to learn from


def test_insults_are_learned_from_labels_but_not_from_copies(spark):
    draw = random.Random(3)
    word = lambda k: f"x{draw.randrange(k)}"
    rows, labels = [], []
    for i in range(400):
        text = [word(400) for _ in range(40)]
        if i % 8 == 0:
            text[draw.randrange(40)], text[draw.randrange(40)] = "glorb", "snarf"
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 8 == 0)))
    family = ["famous"] + [f"once{k}" for k in range(60)] + ["glorb"]
    for i in range(400, 440):
        family[draw.randrange(1, 61)] = word(10**6)
        rows.append((i, " ".join(family)))
        labels.append((i, 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    learned = set(toxicity.learned_insults(docs, marks))
    assert {toxicity.hash_word(w) for w in ("glorb", "snarf")} <= learned
    assert toxicity.hash_word("famous") not in learned and len(learned) <= 4
    assert toxicity.learned_insults(docs, marks.where("toxic = 0")) == () == toxicity.learned_insults(docs, marks.limit(0))
    assert toxicity.score_texts(pa.array(["you glorb", "not a glorb"]), tuple(sorted(learned)))[2].tolist() == [True, False]


# --- 3: exact dedup --------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 30_000])
def test_fuse_filters_hold_every_key(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    f = exact_dedup.build_fuse(np.concatenate((keys, keys)))
    assert exact_dedup.probe_fuse(keys, *f).all()
    assert exact_dedup.probe_fuse(rng.integers(0, 1 << 63, 50_000).astype(np.uint64), *f).mean() < 0.01
    if n > 10_000:
        assert len(f[3]) < 1.3 * n


def test_incoming_against_a_snapshot(spark, docs, texts):
    snapshot, incoming = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    first = {}
    for i in sorted(texts, key=lambda i: (i % 3 != 0, i)):
        first.setdefault(texts[i], i)
    want = {(i, first[t]) for i, t in texts.items() if i % 3 and first[t] != i}
    assert set(map(tuple, exact_dedup.exact_copies(incoming, snapshot).collect())) == want


def test_only_what_the_filter_sees_meets_the_snapshot(spark, monkeypatch):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    batch = spark.createDataFrame([(5, "a"), (6, "c"), (7, "c")], "doc_id long, text string")
    joined, screen, plain_join = [], exact_dedup.screen, type(held).join
    monkeypatch.setattr(exact_dedup, "screen", lambda *x: screen(*x).withColumn("seen", F.lit(False)))

    def join(self, other, *x, **y):
        if "held_id" in other.columns and "held_id" not in self.columns and "first" in self.columns:
            joined.append(self.count())
        return plain_join(self, other, *x, **y)

    monkeypatch.setattr(type(held), "join", join)
    exact_dedup.exact_copies(batch, held)
    assert joined == [0]


def test_copies_equal_grouping(docs, texts):
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    want = {(i, first[t]) for i, t in texts.items() if first[t] != i}
    assert set(map(tuple, exact_dedup.copies_in(docs).collect())) == want
    assert {r.doc_id for r in exact_dedup.without_copies(docs).collect()} == set(first.values())


# --- 4: packing ------------------------------------------------------------------------------


def check_windows(rows, lengths, tiers):
    filled = collections.defaultdict(list)
    spread = collections.defaultdict(list)
    for step, tier, window, start, k, piece, doc_start, n in rows:
        filled[tier, window].append((start, n))
        spread[k].append((piece, doc_start, n))
    for (tier, _), parts in filled.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at <= tier
    assert {k: sum(n for *_, n in v) for k, v in spread.items()} == {k: n for k, n in enumerate(lengths) if n}
    for parts in spread.values():
        at = 0
        for j, (piece, doc_start, n) in enumerate(sorted(parts)):
            assert (piece, doc_start) == (j, at)
            at += n
    return filled


def test_packing_places_every_word_once():
    draw = random.Random(8)
    lengths = [int(draw.paretovariate(0.7) * 10) % 900 + 1 for _ in range(3000)] + [64, 64, 64, 3000]
    tiers = (64, 256, 512)
    rows = packing.pack_lengths(np.arange(len(lengths)), np.array(lengths), tiers, 4096)
    filled = check_windows(rows, lengths, tiers)
    used = collections.Counter()
    for (tier, _), parts in filled.items():
        used[tier] += sum(n for _, n in parts) / tier
    for tier in tiers:
        count = sum(1 for t, _ in filled if t == tier)
        assert used[tier] / count > 0.95
    steps = collections.defaultdict(lambda: [0, 0, 0])
    seen = {}
    for step, tier, window, _, _, _, _, n in rows:
        seen[tier, window] = step
        steps[step][1] += n * n
    for (tier, _), step in seen.items():
        steps[step][0] += tier
        steps[step][2] += 1
    sizes = [s[0] for s in steps.values()]
    assert max(sizes) - min(sizes) <= 2 * max(tiers)
    assert max(s[1] for s in steps.values()) < 1.5 * min(s[1] for s in steps.values())


def plain_best_fit(size, own, shorter):
    """As packing.best_fit, by looking at every window and every item."""
    windows, free = [], []
    for item in sorted(own, reverse=True):
        fits = [(free[k], k) for k in range(len(windows)) if free[k] >= item[0]]
        k = min(fits)[1] if fits else len(windows)
        if not fits:
            windows.append([])
            free.append(size)
        windows[k].append(item)
        free[k] -= item[0]
    order = sorted((k for k in range(len(windows)) if free[k]), key=lambda k: (free[k], k), reverse=True)
    for tier in shorter:
        for k in order:
            while fits := [item for item in tier if item[0] <= free[k]]:
                windows[k].append(max(fits))
                tier.remove(max(fits))
                free[k] -= max(fits)[0]
    return windows, shorter


def test_packing_equals_plain_best_fit():
    draw = random.Random(31)
    for _ in range(60):
        items = [(draw.randrange(1, 65), k, 0, 0) for k in range(draw.randrange(0, 60))]
        own, short, least = (sorted(x for x in items if lo < x[0] <= hi) for lo, hi in ((32, 64), (8, 32), (0, 8)))
        assert packing.best_fit(64, own, [list(short), list(least)]) == plain_best_fit(64, own, [list(short), list(least)])


def test_packing_needs_hardly_more_windows_than_the_best():
    draw = random.Random(32)

    def fewest(sizes, room):
        """Windows of 10 that hold all sizes, by trying every way."""
        if not sizes:
            return len(room)
        best, first = 99, sizes[0]
        for k in range(len(room)):
            if room[k] >= first and room[k] not in room[:k]:
                best = min(best, fewest(sizes[1:], [*room[:k], room[k] - first, *room[k + 1 :]]))
        return min(best, fewest(sizes[1:], [*room, 10 - first]))

    for _ in range(40):
        sizes = sorted((draw.randrange(1, 11) for _ in range(8)), reverse=True)
        used = len(packing.best_fit(10, [(n, k, 0, 0) for k, n in enumerate(sorted(sizes))], [])[0])
        assert fewest(sizes, []) <= used <= fewest(sizes, []) * 11 / 9 + 1


def test_packing_the_table(docs, texts):
    got = packing.packed(docs, shard_words=60_000).collect()
    words = {i: len(re.findall(r"[^ \t\n\r\x0b\x0c]+", t)) for i, t in texts.items()}
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.n_words
    assert total == {i: n for i, n in words.items() if n}
    for shard in {r.shard for r in got}:
        filled = collections.Counter()
        for r in got:
            if r.shard == shard:
                filled[r.tier, r.window_no] += r.n_words
        assert all(n <= tier for (tier, _), n in filled.items())


# --- 5 and 6: tokens -------------------------------------------------------------------------


ODD = ["", " ", "a", " a  b ", "a\nb", "\t x", "日本 　x", "a▁b", "\U0001f600‍♀", "<s>hi</s><0x0A>", " " * 40 + "x" + " " * 17, "a" * 3000, "thethethe banana", "\x00\x7f", "e" * 300 + " in"]


def test_pieces_equal_the_library(texts):
    from sentencepiece import SentencePieceProcessor

    public = SentencePieceProcessor(model_file=piece_codec.MODEL)
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz  eeeettttaaooinsh.,'0189éüñ▁\n日"
    odd = ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 60))) for _ in range(3000)]
    odd += ["".join(draw.choice(["the", "th", "e", "an", "▁", "ing", " ", "in", "on", "i"]) for _ in range(20)) for _ in range(3000)]
    for batch in (odd, list(texts.values())):
        ids, offsets = piece_codec.encode(pa.array(batch, pa.string()))
        back = piece_codec.decode(ids, offsets)
        for k, text in enumerate(batch):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == public.encode(text)
            assert back[k].as_py() == text.replace("▁", " ")


def test_long_words_equal_the_library_at_the_cost_of_short_ones():
    import time

    from sentencepiece import SentencePieceProcessor

    public = SentencePieceProcessor(model_file=piece_codec.MODEL)
    draw = random.Random(9)
    source = "".join(draw.choice("eeettaaoinshrdlucmfwyp") for _ in range(20_000))
    odd = [source, "ab" * 5000, "a" * 4001, "".join(draw.choice(["in", "ing", "the", "er", "tion", "s"]) for _ in range(6000)), "日本語" * 900 + source[:900]]
    ids, offsets = piece_codec.encode(pa.array(odd))
    for k, text in enumerate(odd):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == public.encode(text)
    short = " ".join(source[k : k + 8] for k in range(0, len(source), 8))

    def seconds(text):
        best = 9.0
        for _ in range(5):
            began = time.perf_counter()
            piece_codec.encode(pa.array([text]))
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(source) < 8 * seconds(short)  # about 3 on an idle machine


def test_decoding_broken_bytes_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    public = SentencePieceProcessor(model_file=piece_codec.MODEL)
    ids = np.array([3 + 0xE6, 3 + 0x97, 5365, 3 + 0xFF])
    assert piece_codec.decode(ids, np.array([0, 4]))[0].as_py().count("�") >= 2
    good = np.array(public.encode("héé 日 \U0001f600"))
    assert piece_codec.decode(good, np.array([0, len(good)]))[0].as_py() == public.decode(good.tolist())


def test_token_counts_equal_the_library(docs, texts):
    own = token_counts.encoding(token_counts.VOCABULARY)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got == {i: len(own.encode_ordinary(t)) for i, t in texts.items()}


def test_splitting_long_texts_changes_no_count():
    own = token_counts.encoding(token_counts.VOCABULARY)
    draw = random.Random(6)
    for letters in (["a", "bc", " ", " ", "  ", "\n", "!", "7", "'s", "é", "\t", "<|endoftext|>"], ["a", "日本", "7", "!", "'s", "'", "é"], ["日", "本", "。"]):
        for _ in range(200):
            text = "".join(draw.choice(letters) for _ in range(200))
            pieces = token_counts.safe_pieces(text, 24)
            assert "".join(pieces) == text and len(pieces) > 1
            assert sum(len(own.encode_ordinary(p)) for p in pieces) == len(own.encode_ordinary(text))


def test_pieces_are_bounded_in_bytes():
    for text in ("日本語の文。" * 20_000, "word " * 60_000, "ab12" * 60_000):
        assert max(len(p.encode()) for p in token_counts.safe_pieces(text)) <= token_counts.PIECE_BYTES


# --- 7: substring dedup ----------------------------------------------------------------------


def brute_spans(texts):
    least, first, repeated = substring.MIN_WORDS, {}, collections.defaultdict(list)
    for i in sorted(texts):
        w = re.findall(r"[^ \t\n\r\x0b\x0c]+", texts[i])
        for p in range(len(w) - least + 1):
            if first.setdefault(tuple(w[p : p + least]), (i, p)) != (i, p):
                repeated[i].append(p)
    out = set()
    for i, places in repeated.items():
        a, b = places[0], places[0] + least
        for p in places[1:]:
            if p > b:
                out.add((i, a, b - a))
                a = p
            b = p + least
        out.add((i, a, b - a))
    return out


def test_cover_is_a_difference_cover():
    gaps = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert gaps == set(range(substring.PERIOD))


def test_spans_equal_brute_force(docs, texts):
    got = {tuple(r) for r in substring.repeated_spans(docs).select("doc_id", "first_word", "n_words").collect()}
    assert got == brute_spans(texts) and got


def test_spans_of_every_alignment(spark):
    draw = random.Random(11)
    passage = [f"p{i}" for i in range(substring.MIN_WORDS + 3)]
    rows = {}
    for k in range(70):
        filler = [f"f{k}x{j}" for j in range(90)]
        cutat = draw.randrange(80)
        part = passage[: draw.choice([len(passage), substring.MIN_WORDS, substring.MIN_WORDS - 1])]
        rows[k] = " ".join(filler[:cutat] + part + filler[cutat:])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {tuple(r) for r in substring.repeated_spans(df).select("doc_id", "first_word", "n_words").collect()}
    assert got == brute_spans(rows) and len(got) > 20


def test_stretches_with_other_words_are_dropped(spark):
    words = [f"w{k}" for k in range(200)]
    texts = spark.createDataFrame([(1, " ".join(words), 0), (2, "x \n " + "  ".join(words), 0), (2, "other", 1)], "doc_id long, text string, v long")
    found = cut(spark.createDataFrame([(2, 1, 60, 1, 0), (2, 100, 50, 1, 99), (2, 20, 50, 1, 20)], "doc_id long, at long, n long, of_doc_id long, of_at long"))
    got = substring.repeated_words(found, texts)
    assert {(r.doc_id, r["at"], r.n) for r in got.collect()} == {(2, 1, 60), (2, 100, 50)}
    touching = spark.createDataFrame([(2, 1, 60, 1), (2, 61, 50, 1), (2, 112, 45, 3), (2, 10, 45, 1)], "doc_id long, at long, n long, of_doc_id long")
    assert sorted(map(tuple, substring.merged(touching).collect())) == [(2, 0, 1, 110, 1), (2, 0, 112, 45, 3)]


def test_nothing_repeats_after_the_cut(docs, texts):
    left = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    spans = collections.defaultdict(set)
    for i, a, n in brute_spans(texts):
        spans[i] |= set(range(a, a + n))
    for i, text in texts.items():
        assert left[i].split() == [w for p, w in enumerate(text.split()) if p not in spans[i]]


# --- 8: n-gram join --------------------------------------------------------------------------


def brute_pairs(texts, n, t):
    sets = {}
    for i, text in texts.items():
        w = tokens(text)
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    owner = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        for g in s:
            owner[g].append(i)
    same = collections.Counter((a, b) for ids in owner.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    return {p: k / (len(sets[p[0]]) + len(sets[p[1]]) - k) for p, k in same.items() if k >= t * (len(sets[p[0]]) + len(sets[p[1]]) - k)}


def test_pairs_equal_brute_force(docs, texts):
    got = {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(docs).collect()}
    assert got == brute_pairs(texts, ngram_join.NGRAM, ngram_join.THRESHOLD) and got


def test_pairs_of_edited_copies(spark):
    draw = random.Random(12)
    texts = {}
    for family in range(12):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(20, 300))]
        for copy in range(9):
            texts[family * 100 + copy] = " ".join(f"e{draw.randrange(10**6)}" if draw.random() < 0.02 * copy else w for w in base)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, got = brute_pairs(texts, 3, 0.6), {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(df).collect()}
    assert got.items() <= want.items() and len(got) >= 0.98 * len(want) > 50


def test_large_groups_are_joined_in_blocks(spark, monkeypatch):
    draw = random.Random(21)
    base = [f"w{k}" for k in range(200)]
    texts = {i: " ".join(f"e{draw.randrange(10**6)}" if draw.random() < 0.03 else w for w in base) for i in range(90)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "CROWD", 8)
    assert {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(df).collect()} == brute_pairs(texts, 3, 0.6)


def brute_classes(texts, n=3, t=0.6):
    """{doc_id: (class, links)} by the pairs that brute force finds."""
    pairs = brute_pairs(texts, n, t)
    root = {i: i for i in texts}
    while (low := root | {i: min([root[i], *(root[y] for x, y in pairs if x == i), *(root[x] for x, y in pairs if y == i)]) for i in {i for p in pairs for i in p}}) != root:
        root = low
    links = collections.Counter(i for p in pairs for i in p)
    return {i: (root[i], links[i]) for i in texts}


def test_classes_equal_brute_force(docs, texts):
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.similarity_classes(docs).collect()}
    assert got == brute_classes(texts) and len({c for c, _ in got.values()}) < len(got)


def test_links_of_near_copies_are_counted_and_not_written(spark, monkeypatch):
    draw = random.Random(33)
    base = [f"w{k}" for k in range(120)]
    texts = {i: " ".join(f"e{draw.randrange(10**6)}" if draw.random() < 0.02 else w for w in base) for i in range(120)}
    texts |= {200 + i: texts[i] for i in range(9)} | {300 + i: " ".join([*base[:30], *(f"u{draw.randrange(10**6)}" for _ in range(90))]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_pairs(texts, 3, 0.6)
    for split in (512, 8):  # 8: groups are parted by further hashes
        monkeypatch.setattr(ngram_join, "SPLIT", split)
        got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.similarity_classes(df).collect()}
        assert got == brute_classes(texts)
        assert {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(df).collect()} == want
        monkeypatch.setattr(ngram_join, "CROWD", 16)
    rows = ngram_join.nodes_and_edges(df, 0.6, 3, True)[1].count()
    assert rows < len(want) / 2 and {r.doc_id for r in ngram_join.without_near_copies(df).collect()} == {0} | set(range(300, 360))


def test_near_dedup_writes_rows_in_proportion_to_near_copies(spark, monkeypatch):
    draw = random.Random(34)
    base, written, cut = [f"w{k}" for k in range(100)], [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: (done := cut(df), written.append(done.count()))[0])
    most = []
    for n in (60, 240):
        rows = [(i, " ".join(f"e{draw.randrange(10**6)}" if draw.random() < 0.01 else w for w in base)) for i in range(n)]
        written.clear()
        assert ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1
        most.append(max(written))
    assert most[1] <= 6 * most[0] and most[1] <= ngram_join.ROUTES * 240


def test_sets_are_sent_for_few_rows_without_links(spark, monkeypatch):
    draw = random.Random(35)
    phrase, written, cut = [f"p{k}" for k in range(60)], [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: (done := cut(df), written.append(done))[0])
    texts = {i: " ".join([*phrase, *(f"u{draw.randrange(10**6)}" for _ in range(64))]) for i in range(400)}  # 400 texts, half of each a common phrase
    texts |= {1000 + i: texts[i].rsplit(" ", 3)[0] for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edges = ngram_join.nodes_and_edges(df, 0.6, 3, True)[1]
    sent = [d.select("node").distinct().count() for d in written if "members" in d.columns]
    linked = edges.select("a").distinct().count()
    assert linked == 40 and sent[0] > 200 and sent[-1] <= 1.5 * linked
    assert {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(df).collect()} == brute_pairs(texts, 3, 0.6)


def test_flags_bound_the_overlap_at_every_number_of_flags():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 40, 90, 700, 5000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 3 // 4], rng.integers(0, 1 << 63, len(s) // 5 + 1).astype(np.uint64)))) for s in sets]
    sets += [np.arange(1, 200, dtype=np.uint64), np.arange(1, 150, dtype=np.uint64)]  # all of one flag
    size = np.array([len(s) for s in sets])
    raw, width = ngram_join.packed_flags(np.concatenate(sets), size)
    flags = ngram_join.Flags(size, [v.tobytes() for v in np.split(raw, np.cumsum(width)[:-1])])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    for t in (0.2, 0.6, 0.9):
        near = np.array([len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= t for i, j in zip(a, b)])
        got = flags.reach(a, b, t)
        assert got[near].all() and (t < 0.6 or got.sum() < near.sum() + 10)


def test_a_common_hash_alone_makes_no_pair(monkeypatch):
    rng = np.random.default_rng(9)
    key, size = np.uint64(500), np.full(80, 30)
    gram = [np.unique(np.append(rng.choice(np.setdiff1d(np.arange(1, 1500), [500]), 29, replace=False), 500)).astype(np.uint64) for _ in size]
    vec, width, excess = ngram_join.packed_counts(np.concatenate(gram), size)
    points = ngram_join.Points(size, excess, [v.tobytes() for v in np.split(vec, np.cumsum(width)[:-1])])
    routes = np.array([g[:20] for g in gram])
    holds = np.flatnonzero((routes == key).any(1))
    common = {(i, j): set(routes[i].tolist()) & set(routes[j].tolist()) for i in holds.tolist() for j in holds.tolist() if i < j}
    want = sorted(p for p, c in common.items() if min(c) == 500 and len(c) > 1)
    for met in (1 << 21, 64):
        monkeypatch.setattr(ngram_join, "MET", met)
        got = [tuple(sorted(p)) for a, b in ngram_join.split_pairs(points, holds, routes, key, 0.01) for p in zip(a.tolist(), b.tolist())]
        assert sorted(got) == want and 0 < len(want) < len(common) / 2


def test_components_within_a_task():
    rng = np.random.default_rng(8)
    label, seen = np.arange(200), np.arange(200)
    for _ in range(6):
        a, b = rng.integers(0, 200, (2, 20))
        ngram_join.joined(label, a, b)
        for x, y in zip(a.tolist(), b.tolist()):
            seen[(seen == seen[x]) | (seen == seen[y])] = min(seen[x], seen[y])
        assert label.tolist() == seen.tolist()


def test_points_bound_the_overlap_at_every_number_of_groups():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 40, 90, 700, 5000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 3 // 4], rng.integers(0, 1 << 63, len(s) // 5 + 1).astype(np.uint64)))) for s in sets]
    sets.append(np.arange(1, 200, dtype=np.uint64))  # all in one group
    sets.append(np.concatenate((sets[-1], np.arange(1, 150, dtype=np.uint64) << np.uint64(20))))
    size = np.array([len(s) for s in sets])
    vec, width, excess = ngram_join.packed_counts(np.concatenate(sets), size)
    cuts = np.cumsum(width)[:-1]
    points = ngram_join.Points(size, excess, [v.tobytes() for v in np.split(vec, cuts)])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    for t in (0.2, 0.6, 0.9):
        near = np.array([len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= t for i, j in zip(a, b)])
        assert points.reach(a, b, t)[near].all()


def test_tree_drops_no_pair_that_its_bound_allows():
    rng = np.random.default_rng(3)
    vec = rng.poisson(2, (300, 64))
    vec[150:] = vec[:150] + (rng.random((150, 64)) < 0.05)
    size, none = vec.sum(1), np.zeros(300, np.int64)
    kin = np.where(np.arange(300) % 3 == 0, np.arange(300) % 2 + 1, 0)
    got = [tuple(sorted(p)) for a, b in ngram_join.RTree(vec, size, none, kin).pairs(0.8) for p in zip(a.tolist(), b.tolist())]
    near = [(i, j) for i in range(300) for j in range(i + 1, 300) if np.minimum(vec[i], vec[j]).sum() * 1.8 >= 0.8 * (size[i] + size[j]) - 1e-9 and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])]
    want = {(i, j) for i, j in near if kin[i] != kin[j] or kin[i] == 0}
    assert set(got) == want and len(got) == len(want) >= 100


def test_pairs_are_made_where_they_meet_first():
    rng = np.random.default_rng(5)
    routes = np.sort(rng.integers(0, 40, (60, 6)), axis=1).astype(np.uint64)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    common = [sorted(set(routes[i].tolist()) & set(routes[j].tolist())) for i, j in zip(a, b)]
    some = np.array([bool(c) for c in common])
    a, b, common = a[some], b[some], [c for c in common if c]
    key = np.array([c[k % len(c)] for k, c in enumerate(common)], np.uint64)
    assert ngram_join.first_common(routes, a, b, key, 100).tolist() == [k == c[0] for k, c in zip(key.tolist(), common)]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, 90), (90, 95)]
    got = {r.id: r.root for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {95: 90, 100: 90}


def test_one_document_of_each_group_stays(docs, texts):
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_pairs(texts, 3, 0.6):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {r.doc_id for r in ngram_join.without_near_copies(docs).collect()} == {i for i in texts if root(i) == i}


# --- 9: licences -----------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_patience_is_an_alignment():
    draw = random.Random(7)
    for _ in range(500):
        a, b = ([draw.randrange(12) for _ in range(draw.randrange(0, 20))] for _ in range(2))
        got = license_scan.patience(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) <= longest_common(a, b)
    same = list("the licence of the work")
    assert len(license_scan.patience(same, same)) == len(same)


def plain_patience(a, b):
    """Length of the patience alignment, by the rules as they are told."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + plain_patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + plain_patience(a[:-1], b[:-1])
    both = [(a.index(w), b.index(w)) for w in set(a) if a.count(w) == b.count(w) == 1]
    both.sort(key=lambda x: x[1])
    chains = []
    for x, y in both:
        before = max((c for c in chains if c[-1][0] < x), key=len, default=[])
        chains.append([*before, (x, y)])
    if not chains:
        return 0
    best, total, at = max(chains, key=len), 0, (0, 0)
    for x, y in [*best, (len(a), len(b))]:
        total += plain_patience(a[at[0] : x], b[at[1] : y])
        at = x + 1, y + 1
    return total + len(best)


def test_patience_aligns_all_that_it_should():
    draw = random.Random(17)
    for _ in range(300):  # unlike words: all that was kept is found
        a = [f"w{k}" for k in range(draw.randrange(1, 60))]
        b = [w if draw.random() < 0.7 else f"x{draw.randrange(10**6)}" for w in a if draw.random() < 0.9]
        assert len(license_scan.patience(a, b)) == longest_common(a, b)
    ties = 0
    for _ in range(500):
        a, b = ([draw.randrange(30) for _ in range(draw.randrange(0, 25))] for _ in range(2))
        got, want = len(license_scan.patience(a, b)), plain_patience(a, b)
        ties += got != want  # of equally long chains of anchors either may be taken
    assert ties <= 50


def test_every_match_of_a_notice_is_given():
    line, filler = license_scan.TEMPLATES["MIT notice"], "lorem ipsum dolor sit amet " * 5
    found = license_scan.scan_texts(pa.array([f"{line} {filler} {line} {filler} Released under the new MIT License {line}"]), license_scan.TEMPLATES, 0.8)
    assert [(n, a, b) for _, _, n, a, b in found] == [(5, 0, 4), (5, 30, 34), (5, 60, 65), (5, 66, 70)]


def test_whole_licence_texts_from_a_folder(spark, tmp_path):
    draw = random.Random(40)
    long = [f"term{draw.randrange(900)}" for _ in range(4000)]
    (tmp_path / "Own-1.0.txt").write_text("\n".join(long))
    (tmp_path / "Short text.txt").write_text("do what you like")
    (tmp_path / "none.txt").write_text(" ")
    templates = license_scan.templates_in(spark, str(tmp_path))
    assert list(templates) == ["Own-1.0", "Short text"]
    edited = [w for w in long if draw.random() < 0.95]
    df = spark.createDataFrame([(1, "before " + " ".join(edited) + " after"), (2, " ".join(long[:2000])), (3, "Do what you like!")], "doc_id long, text string")
    got = {(r.doc_id, r.license): r.coverage for r in license_scan.license_scan(df, templates).collect()}
    assert got.keys() == {(1, "Own-1.0"), (3, "Short text")} and got[3, "Short text"] == 1
    assert 0.9 < got[1, "Own-1.0"] <= len(edited) / len(long)


def test_scan_finds_planted_and_edited_notices():
    draw = random.Random(13)
    names = list(license_scan.TEMPLATES)
    for k, name in enumerate(names):
        words = re.findall(r"\S+", license_scan.TEMPLATES[name])
        if len(words) > 12:
            words[5:5], words[9] = ["some"], "changed"
        filler = [draw.choice(["the", "of", "and", "lorem", "under", "version"]) for _ in range(400)]
        text = " ".join(filler[:200] + words + filler[200:])
        found = {t: n for _, t, n, _, _ in license_scan.scan_texts(pa.array([text, " ".join(filler)]), license_scan.TEMPLATES, 0.8)}
        assert k in found
        assert not license_scan.scan_texts(pa.array([" ".join(filler)]), license_scan.TEMPLATES, 0.8)


def test_scan_equals_looking_for_the_lines(docs, texts):
    got = collections.defaultdict(set)
    for r in license_scan.license_scan(docs).where("coverage = 1").collect():
        got[r.license].add(r.doc_id)
    for name in ("Apache-2.0 notice", "MIT notice", "GPL-3.0 notice", "CC-BY-NC-4.0 notice", "All rights reserved"):
        line = " ".join(tokens(license_scan.TEMPLATES[name]))
        assert got[name] == {i for i, t in texts.items() if f" {line} " in f" {' '.join(tokens(t))} "}


# --- 10: quality -----------------------------------------------------------------------------


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * (x[:, 0] * x[:, 1] > 0) + 1.5))).astype(float)
    net = quality.train(x[:2400], y[:2400])
    p = quality.probability(net, x[2400:])
    best = np.where(x[2400:, 0] * x[2400:, 1] > 0, 0.82, 0.18)
    assert np.mean((p > 0.5) == (best > 0.5)) > 0.9
    assert abs(p.mean() - y[2400:].mean()) < 0.08


def test_word_vectors_do_not_depend_on_partitions(docs):
    one, many = quality.context_sums(docs.coalesce(1)), quality.context_sums(docs.repartition(5))
    assert np.array_equal(one, many) and one[:, quality.DIMS].sum() > 50_000


def test_every_word_has_its_own_vector_and_count(spark):
    texts = [" ".join(f"w{k} the w{k}" for k in range(s, s + 1000)) for s in range(0, 20_000, 1000)] + ["", None, "the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sums = quality.context_sums(df)
    assert len(sums) == 20_001 and sorted(sums[:, quality.DIMS].tolist())[-2:] == [2.0, 20_002.0]
    h = np.unique(np.concatenate([quality.hashed(pa.array([t], pa.string()))[1] for t in texts]))
    vectors = quality.word_vectors(sums)
    got = {r.doc_id: np.frombuffer(r.x, np.float32) for r in quality.pooled(df).collect()}
    for i, t in enumerate(texts):
        at = np.searchsorted(h, quality.hashed(pa.array([t], pa.string()))[1])
        assert np.allclose(got[i], vectors[at].mean(0) if len(at) else 0, atol=1e-5)


def test_context_sums_equal_a_plain_count(docs, texts):
    split = re.compile(r"""[a-zA-Z0-9'\x80-\U0010ffff]+|[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+""")
    number, plain, counts = {}, collections.defaultdict(lambda: np.zeros(quality.DIMS)), collections.Counter()
    for text in texts.values():
        words = split.findall(text)
        counts.update(words)
        for w in set(words) - number.keys():
            h = hash_runs(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])).view(np.int64)
            spot, sign = quality.index_vectors(h)
            number[w] = (int(h[0]), np.bincount(spot[0], sign[0], quality.DIMS))
        for k, w in enumerate(words):
            for j in range(max(0, k - quality.NEIGHBOURS), min(len(words), k + quality.NEIGHBOURS + 1)):
                if j != k:
                    plain[w] += number[words[j]][1]
    order = sorted(number, key=lambda w: number[w][0])
    want = np.array([[*plain[w], counts[w]] for w in order])
    assert np.array_equal(quality.context_sums(docs), want)


def test_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5))
    net = quality.train(x, (x[:, 0] > 0).astype(float))
    for row, p in zip(x, quality.probability(net, x)):
        z = [(v - m) / s for v, m, s in zip(row, net["mean"], net["std"])]
        hidden = [np.tanh(sum(z[i] * net["w1"][i, j] for i in range(5)) + net["b1"][j]) for j in range(quality.HIDDEN)]
        logit = sum(v * w for v, w in zip(hidden, net["w2"])) + net["b2"]
        assert abs(p - 1 / (1 + np.exp(-logit / net["temperature"]))) < 1e-12


@pytest.mark.parametrize("sizes", [(1, 1), (40, 900), (1 << 18, 1 << 22)])
def test_units_of_any_size_pool_alike(docs, texts, monkeypatch, sizes):
    monkeypatch.setattr(quality, "UNIT_WORDS", sizes[0])
    monkeypatch.setattr(quality, "UNIT_TOKENS", sizes[1])
    few = docs.where("doc_id % 4 = 0").repartition(3, "doc_id")
    sums = quality.context_sums(few)
    h = np.unique(np.concatenate([quality.hashed(pa.array([t]))[1] for i, t in texts.items() if i % 4 == 0]))
    vectors = quality.word_vectors(sums)
    got = {r.doc_id: np.frombuffer(r.x, np.float32) for r in quality.pooled(few).collect()}
    assert got.keys() == {i for i in texts if i % 4 == 0}
    for i, x in got.items():
        at = np.searchsorted(h, quality.hashed(pa.array([texts[i]]))[1])
        assert np.allclose(x, vectors[at].mean(0) if len(at) else 0, atol=1e-5)


def test_held_out_accuracy(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = documents(spark, folder), documents(spark, folder, "labels")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.quality_scores(docs, train).join(test, "doc_id").select("probability", "keep", "quality").toPandas()
    right = (got["keep"] == (got["quality"] == 1)).mean()
    assert right > max(got["quality"].mean(), 1 - got["quality"].mean())
    brier = ((got["probability"] - got["quality"]) ** 2).mean()
    assert brier < got["quality"].var()
