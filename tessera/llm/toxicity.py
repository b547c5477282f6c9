"""Toxicity by a weighted finite-state pattern grammar.

Small transducers for negation, insult, target, threat and reported speech read a clause's
symbols one after the other; their composition is one deterministic table, which scores all clauses
of an Arrow slice at once, a symbol a step. A word alone decides nothing: its clause does. A denied
insult ("not an idiot") weighs nothing, one aimed at someone weighs double, and what is quoted or
stands in a clause that reports speech is discounted. A document's length decides nothing: clauses that hold more than one
unaimed insult add up over all of it, those with less (it may be about clowns or trash) where they stand near each other.

Symbols come from a lexicon for each language, read in the language of the clause (by its function words), and
from insults that are learned at run time: words that labelled toxic documents have and clean ones don't.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_table, cut, flat, hash_runs, hash_word, in_slices, keep_ids, mix, once, runs, small_batches, text_slices, words

INSULT, THREAT, WISH, TARGET, NEGATION, REPORT, INTENT, QUOTE, BREAK, GAP, OBJECT, CONTRAST, DENIED = range(1, 14)
SYMBOLS = 14
#: OBJECT: a target that stands before the deed, where verbs come last ("ich werde dich ...").
LEXICON = {
    "en": {
        INSULT: "stupid idiot idiots idiotic moron morons moronic worthless pathetic trash disgusting scum loser losers clown clowns dumb dumbass imbecile imbeciles cretin vermin filth filthy garbage subhuman degenerate degenerates asshole assholes bastard bastards bitch bitches retard retarded freak freaks parasite parasites repulsive vile",
        THREAT: "kill hurt destroy murder shoot stab strangle punch beat crush slaughter exterminate",
        WISH: "die suffer rot perish",
        TARGET: "you your you're youre yourself yourselves u ur he he's she she's they they're him her them his their theirs these those people everyone everybody women men immigrants refugees",
        NEGATION: "not no never isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot couldn't shouldn't ain't neither nor hardly without nobody",
        REPORT: "said says say saying called calls calling wrote writes quoted quotes claimed claims accused reported reports reportedly told tells shouted yelled allegedly according described describes",
        INTENT: "will gonna going should must i'll we'll they'll i'm let's want wanna ought hope deserve deserves shall",
        CONTRAST: "but yet however rather instead",
    },
    "de": {
        INSULT: "idiot idioten idiotisch idiotin dummkopf dummköpfe blödmann trottel depp deppen versager versagerin abschaum arschloch arschlöcher schwachkopf schwachköpfe wertlos wertlose wertloser erbärmlich erbärmliche erbärmlicher widerlich widerliche widerlicher ekelhaft ekelhafte drecksack dreckskerl mistkerl hurensohn schlampe ungeziefer untermensch untermenschen parasit parasiten dumm dumme dummer blöd blöde blöder missgeburt",
        THREAT: "töten umbringen ermorden erschlagen erschießen erstechen verprügeln vernichten ausrotten abstechen erwürgen",
        WISH: "sterben verrecken krepieren verrotten",
        TARGET: "du ihr dein deine euer eure er sie ihn ihm ihnen diese leute alle frauen männer ausländer flüchtlinge",
        OBJECT: "dich dir euch",
        NEGATION: "nicht kein keine keinen keiner nie niemals weder ohne kaum niemand",
        REPORT: "sagte sagt sagen schrieb schreibt nannte nennt behauptete behauptet angeblich laut rief erzählte berichtete zitierte beschrieb",
        INTENT: "werde werden wird will wollen soll sollst sollen sollt muss musst müssen möge hoffe verdienst verdient",
        CONTRAST: "aber sondern doch jedoch",
    },
    "fr": {
        INSULT: "idiot idiote idiots idiotes imbécile imbéciles crétin crétine crétins abruti abrutie abrutis débile débiles connard connards connasse salaud salauds salope ordure ordures vermine raclure minable minables pathétique dégoûtant dégoûtante répugnant répugnante stupide stupides bouffon bouffons parasite parasites dégénéré dégénérés",
        THREAT: "tuer frapper détruire assassiner étrangler poignarder massacrer exterminer écraser cogner",
        WISH: "mourir crever souffrir pourrir",
        TARGET: "tu toi vous ton ta tes votre vos il elle ils elles eux leur ces gens femmes hommes immigrés réfugiés",
        OBJECT: "te t'",
        NEGATION: "pas ne jamais aucun aucune sans ni guère personne",
        REPORT: "dit dis disait écrit écrivait appelé appelle traité accusé prétend prétendait selon raconté déclaré cité décrit",
        INTENT: "vais va allons vont dois doit devrais devrait devez veux veut voulons espère mérite mérites",
        CONTRAST: "mais plutôt cependant pourtant",
    },
    "es": {
        INSULT: "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos estúpidas tonto tonta tontos cretino cretina pendejo pendeja gilipollas cabrón cabrones basura escoria asqueroso asquerosa patético patética payaso payasos inútil inútiles miserable miserables parásito parásitos degenerado degenerados malnacido desgraciado",
        THREAT: "matar golpear destruir asesinar estrangular apuñalar aplastar exterminar matarte matarlos matarlas golpearte destruirte",
        WISH: "morir morirte sufrir pudrirte pudrirse reventar",
        TARGET: "tú tu tus usted ustedes vosotros él ella ellos ellas su sus estos esos esas gente mujeres hombres inmigrantes refugiados eres",
        OBJECT: "te os",
        NEGATION: "no nunca jamás ningún ninguna sin ni tampoco nadie",
        REPORT: "dijo dice decía escribió escribe llamó llama acusó afirmó según contó gritó citó describió",
        INTENT: "voy va vamos van debo debes debe deberías debería quiero queremos espero merece mereces",
        CONTRAST: "pero sino",
    },
}
LANGUAGES = tuple(LEXICON)
#: Words that tell a clause's language, besides its lexicon's pronouns, verbs and negations.
FUNCTION = {
    "en": "the a an and of to in is are was were be it that this with for on as at by from or so such how what i my me we who",
    "de": "der die das den dem des und in ist sind war ein eine einen einem einer mit für auf im zu von als wie bei aus nach es ich wir was so auch",
    "fr": "le la les l de des du d et un une est es êtes suis sont que qui dans pour avec sur par au aux en ce cette son sa ses je nous se",
    "es": "el la los las de del y un una es son que en por para con al se lo le como más ya yo nos o",
}
FILLERS = 4  # so many other words in a row part what stands on either side
WEIGHT = {"insult": 0.5, "aimed": 0.5, "threat": 1.5, "bare threat": 0.75, "wish": 1.5, "reported": 0.25}
#: A document is toxic from this score on. Clauses of at most LONE count only together with those within NEAR words.
THRESHOLD, LONE, NEAR = 1.0, 0.5, 1000
#: Labelled rows from which insults are learned, at most: the lowest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: A learned word is in so many toxic documents and neighbourhoods at least, and has this log-odds ratio.
LEAST, ODDS = 3, 3.0
#: So many of the words that are in as many documents as it may stand as often in toxic ones by chance.
BY_CHANCE = 5


class Transducer(NamedTuple):
    """step(state, symbol) -> (state, symbol written, weight); final(state): factor at a clause's end; scale(state): factor of what others weigh there."""

    start: object
    step: Callable
    final: Callable
    scale: Callable = lambda s: 1.0


def negation() -> Transducer:
    def step(s, x):
        if x in (GAP, BREAK, CONTRAST):
            return 0, x, 0.0
        return (1, x, 0.0) if x == NEGATION else (s, DENIED if s and x in (INSULT, THREAT, WISH) else x, 0.0)

    return Transducer(0, step, lambda s: 1.0)


def insult() -> Transducer:
    return Transducer(0, lambda s, x: (0, x, WEIGHT["insult"] * (x == INSULT)), lambda s: 1.0)


def target() -> Transducer:
    """0: neither stands near; 1: a target does; 2: an insult does, still without a target."""

    def step(s, x):
        if x in (GAP, BREAK):
            return 0, x, 0.0
        if x in (TARGET, OBJECT):
            return 1, x, WEIGHT["aimed"] * (s == 2)
        if x == INSULT:
            return (1, x, WEIGHT["aimed"]) if s == 1 else (2, x, 0.0)
        return s, x, 0.0

    return Transducer(0, step, lambda s: 1.0)


def threat() -> Transducer:
    """1: intent; 2: intent and a deed; 3: a deed; 4: a target; 5: a target and intent; 6: an object; 7: an object and intent."""

    def step(s, x):
        if x in (GAP, BREAK):
            return 0, x, 0.0
        if x == INTENT:
            return {4: 5, 5: 5, 6: 7, 7: 7}.get(s, 1), x, 0.0
        if x == THREAT:
            return {1: 2, 5: 2, 7: 0}.get(s, 3), x, WEIGHT["threat"] * (s == 7)
        if x == WISH:
            return 0, x, WEIGHT["wish"] * (s in (5, 7))
        if x in (TARGET, OBJECT):
            met = {2: WEIGHT["threat"], 3: WEIGHT["bare threat"]}.get(s, 0.0)
            if x == OBJECT:
                return (7 if s in (1, 5, 7) else 6), x, met
            return {1: 1, 5: 5, 7: 7}.get(s, 4), x, met
        return s, x, 0.0

    return Transducer(0, step, lambda s: 1.0)


def reported() -> Transducer:
    """(whether a verb reports speech, whether a quotation is open)."""

    def step(s, x):
        said, quoted = s
        return (said or x == REPORT, quoted != (x == QUOTE)), x, 0.0

    return Transducer((False, False), step, lambda s: WEIGHT["reported"] if s[0] else 1.0, lambda s: WEIGHT["reported"] if s[1] and not s[0] else 1.0)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes; weights add, each scaled by the other's state, and factors multiply."""

    def step(s, x):
        sa, y, wa = a.step(s[0], x)
        sb, z, wb = b.step(s[1], y)
        return (sa, sb), z, wa * b.scale(s[1]) + wb * a.scale(s[0])

    return Transducer((a.start, b.start), step, lambda s: a.final(s[0]) * b.final(s[1]), lambda s: a.scale(s[0]) * b.scale(s[1]))


def grammar() -> Transducer:
    whole = negation()
    for part in (insult(), target(), threat(), reported()):
        whole = compose(whole, part)
    return whole


def tables(t: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, weight, final factor) of every state that can be reached; the first is the start."""
    states, follow, weight = [t.start], [], []
    number = {t.start: 0}
    for s in states:  # grows while it is read
        row = [t.step(s, x) for x in range(SYMBOLS)]
        for nxt, _, _ in row:
            if nxt not in number:
                number[nxt] = len(states)
                states.append(nxt)
        follow.append([number[nxt] for nxt, _, _ in row])
        weight.append([w for _, _, w in row])
    return np.array(follow), np.array(weight), np.array([t.final(s) for s in states])


class Lexicon(NamedTuple):
    """Hashes, in order, with their symbol and whether they are a function word, in each language."""

    known: np.ndarray
    kind: np.ndarray
    function: np.ndarray


def lexicon(learned: tuple[int, ...] = ()) -> Lexicon:
    return once(f"toxicity lexicon {hash(learned)}", lambda: make_lexicon(learned))


def make_lexicon(learned: tuple[int, ...]) -> Lexicon:
    kind: dict[int, list[int]] = {}
    function: dict[int, list[bool]] = {}
    for k, name in enumerate(LANGUAGES):
        for symbol, line in LEXICON[name].items():
            for w in line.split():
                kind.setdefault(hash_word(w), [0] * len(LANGUAGES))[k] = symbol
                if symbol in (TARGET, OBJECT, NEGATION, INTENT):
                    function.setdefault(hash_word(w), [False] * len(LANGUAGES))[k] = True
        for w in FUNCTION[name].split():
            function.setdefault(hash_word(w), [False] * len(LANGUAGES))[k] = True
    for h in learned:
        if h not in function:
            kind[h] = [x or INSULT for x in kind.get(h, [0] * len(LANGUAGES))]
    known = sorted(kind.keys() | function.keys())
    none = [0] * len(LANGUAGES)
    return Lexicon(np.array(known, np.uint64), np.array([kind.get(h, none) for h in known]), np.array([function.get(h, none) for h in known], bool))


#: Bytes of words, of a clause's end, of a pause and of a quotation mark.
KINDS = byte_table("abcdefghijklmnopqrstuvwxyz0123456789'", ".!?;\n", ",:()|", '"', high=1)


def plain(text: pa.Array) -> pa.Array:
    """text in lower case with straight quotation marks."""
    for curly, straight in (("“", '"'), ("”", '"'), ("„", '"'), ("«", '"'), ("»", '"'), ("’", "'")):
        text = pc.replace_substring(text, curly, straight)
    return pc.utf8_lower(text)


def languages(doc: np.ndarray, clause: np.ndarray, function: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Language of each clause: the one with most function words there, else in its document, else the first."""
    n, docs = len(of), int(of[-1]) + 1 if len(of) else 0
    here = np.stack([np.bincount(clause, function[:, k], n) for k in range(len(LANGUAGES))], 1)
    whole = np.stack([np.bincount(of, here[:, k], docs) for k in range(len(LANGUAGES))], 1)
    # The document's language decides ties.
    return np.argmax(here + 0.5 * (np.argmax(whole, 1)[of][:, None] == np.arange(len(LANGUAGES))), 1)


class Clauses(NamedTuple):
    """Symbols, the clause of each, the document of each clause, words before each clause in all documents, and whether it begins within a quotation."""

    symbol: np.ndarray
    clause: np.ndarray
    of: np.ndarray
    before: np.ndarray
    quoted: np.ndarray


def clause_symbols(text: pa.Array, learned: tuple[int, ...] = ()) -> Clauses:
    """The clauses of texts that plain() has been applied to."""
    own = lexicon(learned)
    data, offsets = flat(text)
    doc, start, end = runs(data, offsets, KINDS)
    kind = KINDS[data[start]] if len(start) else np.zeros(0, np.uint8)
    word = kind == 1
    h = hash_runs(data, start[word], end[word])
    at = np.minimum(np.searchsorted(own.known, h), len(own.known) - 1)
    there = own.known[at] == h
    begins = np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)] | np.concatenate(([False], kind[:-1] == 2))[: len(doc)]
    clause = np.cumsum(begins) - 1
    of, before = doc[begins], (np.cumsum(word) - word)[begins]
    language = languages(doc[word], clause[word], own.function[at] & there[:, None], of)
    symbol = np.select([kind == 3], [BREAK], 0)
    symbol[word] = np.where(there, own.kind[at, language[clause[word]]], 0)
    # Quotation marks pair off within a line; an odd last one opens nothing.
    mark = np.flatnonzero(kind == 4)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=ends[1:])
    line = ends[start[mark]] + doc[mark] * 1.0 * (len(data) + 1)
    first = np.searchsorted(line, line)
    turn = np.arange(len(mark)) - first
    paired = (turn % 2 == 1) | (np.append(line[1:], -1)[: len(line)] == line)
    symbol[mark[paired]] = QUOTE
    inside = np.cumsum(symbol == QUOTE) - (symbol == QUOTE)
    quoted = inside[begins] % 2 == 1
    other = word & (symbol == 0)
    first = other & ~np.concatenate(([False], other[:-1] & (clause[1:] == clause[:-1])))[: len(other)]
    head = np.flatnonzero(first)
    length = np.add.reduceat(other, head, dtype=np.int64) if len(head) else head  # others end each run: what is no filler adds 0
    symbol[head[length >= FILLERS]] = GAP
    keep = symbol > 0
    return Clauses(symbol[keep], clause[keep], of, before, quoted)


def score_clauses(symbol: np.ndarray, clause: np.ndarray, n: int, quoted: np.ndarray | None = None) -> np.ndarray:
    """Score of each of n clauses; all of them take one step of the table at a time."""
    follow, weight, final = once("toxicity grammar", lambda: tables(grammar()))
    size = np.bincount(clause, minlength=n)
    order = np.argsort(-size, kind="stable")
    first = (np.cumsum(size) - size)[order]
    still = np.searchsorted(-size[order], -np.arange(size.max() if n else 0), side="left")
    state, score = np.zeros(n, np.int64), np.zeros(n)
    if quoted is not None:
        state[quoted[order]] = follow[0, QUOTE]
    for t, m in enumerate(still):
        x = symbol[first[:m] + t]
        score[:m] += weight[state[:m], x]
        state[:m] = follow[state[:m], x]
    out = np.empty(n)
    out[order] = score * final[state]
    return out


def weighed(score: np.ndarray, of: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """What counts of each of n documents: its clauses' scores above LONE, and the most that others have within NEAR words."""
    out = np.bincount(of, np.where(score > LONE, score, 0), n)
    low = np.flatnonzero((score > 0) & (score <= LONE))
    if len(low):
        total = np.concatenate(([0], np.cumsum(score[low])))
        first = np.maximum(np.searchsorted(before[low], before[low] - NEAR), np.searchsorted(of[low], of[low]))
        most = np.zeros(n)
        np.maximum.at(most, of[low], total[1:] - total[first])
        out += most
    return out


def score_texts(text: pa.Array, learned: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, clauses that scored, toxic) of each text."""
    n = len(text)
    score, matched, toxic = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
    text = plain(text)
    # Only texts with a word that can weigh anything are read clause by clause.
    own = lexicon(learned)
    heavy = own.known[np.isin(own.kind, (INSULT, THREAT, WISH)).any(1)]
    doc, h, _ = words(text, KINDS == 1, lower=False)
    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
    hit = np.unique(doc[heavy[at] == h])
    if len(hit):
        c = clause_symbols(text.take(pa.array(hit)), learned)
        scores = score_clauses(c.symbol, c.clause, len(c.of), c.quoted)
        score[hit] = np.bincount(c.of, scores, len(hit))
        matched[hit] = np.bincount(c.of, scores > 0, len(hit))
        toxic[hit] = weighed(scores, c.of, c.before, len(hit)) >= THRESHOLD
    return score, matched, toxic


def toxicity_of(text: str = "text", learned: tuple[int, ...] = ()) -> Column:
    """struct<score, clauses, toxic> of a string column."""

    def scored(part: pa.Array) -> pa.Array:
        score, matched, toxic = score_texts(part, learned)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(matched), pa.array(toxic)], ["score", "clauses", "toxic"])

    return F.arrow_udf(lambda column: in_slices(scored, column), "struct<score:double,clauses:bigint,toxic:boolean>")(text)


def neighbourhoods(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, bits) of each distinct word of each text; a bit of 64 for each pair of neighbours that it has there."""
    doc, h, _ = words(plain(text), KINDS == 1, lower=False)
    if not len(doc):
        return doc, h, h
    left, right = np.append(np.uint64(0), h[:-1]), np.append(h[1:], np.uint64(0))
    left[np.append(True, doc[1:] != doc[:-1])] = 0
    right[np.append(doc[1:] != doc[:-1], True)] = 0
    bit = np.uint64(1) << (mix(mix(left) + right) >> np.uint64(58))
    order = np.lexsort((h, doc))
    doc, h, bit = doc[order], h[order], bit[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
    return doc[first], h[first], np.bitwise_or.reduceat(bit, first)


def one_of_each_family(sample: DataFrame) -> DataFrame:
    """sample(doc_id, text, toxic) with one row of those that share one of three smallest hashes of word pairs; bounded by the sample."""

    def sketch(batches):
        for batch in text_slices(batches):
            doc, h, _ = words(plain(batch.column("text")), KINDS == 1, lower=False)
            if not len(doc):
                continue
            following = np.where(np.append(doc[1:] == doc[:-1], False), np.append(h[1:], np.uint64(0)), np.uint64(0))
            pair = mix(mix(h) + following)
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            low = [pa.array(np.minimum.reduceat(mix(pair ^ np.uint64(seed)), first).view(np.int64)) for seed in (1, 2, 3)]
            of = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("doc_id", "text", "toxic")), *low], ["doc_id", "text", "toxic", "k1", "k2", "k3"])

    sketched = sample.mapInArrow(sketch, sample.schema.simpleString()[7:-1].replace(":", " ") + ", k1 long, k2 long, k3 long")
    sketched = cut(sketched)
    few = sketched.select("doc_id", "k1", "k2", "k3")
    for k in ("k1", "k2", "k3"):
        rest = [c for c in ("k1", "k2", "k3") if c != k]
        few = few.groupBy(k).agg(F.min_by(F.struct("doc_id", *rest), "doc_id").alias("least")).select(k, "least.*")
    stay = cut(few.select("doc_id").distinct())
    return keep_ids(sketched, stay).dropDuplicates(["doc_id"])


def learned_insults(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[int, ...]:
    """Hashes of the words that tell toxic documents from clean ones, from at most `rows` labelled documents.

    A word counts once a document, of a family of copies one counts, and a word's neighbourhoods are counted
    too, so that what copies share by being copies isn't learned. Labels with a null doc_id or a null toxic aren't used; of several labels
    of a doc_id the highest counts. Without toxic or without clean labels nothing is learned.
    What comes to the driver is bounded by the sample: the words that are candidates.
    """
    pick = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = cut(pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    mine = keep_ids(docs.select("doc_id", "text").where("text is not null"), pick.select("doc_id")).join(F.broadcast(pick), "doc_id")
    mine = one_of_each_family(cut(small_batches(mine)))
    total = {bool(r.toxic): r["count"] for r in mine.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return ()

    def count(batches):
        for batch in text_slices(batches):
            doc, h, bits = neighbourhoods(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[doc] > 0
            word, at = np.unique(h, return_inverse=True)
            near = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(near, at[toxic], bits[toxic])
            bad, good = np.bincount(at[toxic], minlength=len(word)), np.bincount(at[~toxic], minlength=len(word))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bad), pa.array(good), pa.array(near.view(np.int64))], ["h", "bad", "good", "near"])

    counts = small_batches(mine.select("text", "toxic")).mapInArrow(count, "h long, bad long, good long, near long")
    counts = counts.groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_count(F.bit_or("near")).alias("near"))
    counts = cut(counts.withColumn("n", F.col("bad") + F.col("good")).where(F.col("n") >= LEAST))
    alike = {r.n: r["count"] for r in counts.groupBy("n").count().collect()}
    odds = F.log((F.col("bad") + 0.5) / (total[True] - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (total[False] - F.col("good") + 0.5))
    found = counts.where((F.col("bad") >= LEAST) & (F.col("near") >= LEAST) & (odds >= ODDS)).select("h", "bad", "n").collect()
    share = total[True] / sum(total.values())
    return tuple(sorted(r.h & (1 << 64) - 1 for r in found if alike[r.n] * tail(r.n, r.bad, share) <= BY_CHANCE))


def tail(n: int, least: int, p: float) -> float:
    """Probability of `least` or more of n, each with probability p."""
    below = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p) for k in range(least, n + 1)]
    return sum(map(exp, below))


def toxic_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, clauses, toxic) of the documents that are rejected, a row for each row of theirs.

    labels(doc_id, toxic), if given, teaches insults beside the lexicon's; see learned_insults.
    A null or empty text has score 0 and isn't rejected; a null doc_id stays null in the result.
    Repeated rows are scored each for itself. Long texts are read whole; other columns aren't read.
    An empty table gives no rows.
    """
    learned = () if labels is None else learned_insults(docs, labels)
    rows = small_batches(docs).select("doc_id", toxicity_of("text", learned).alias("t"))
    return rows.where("t.toxic").select("doc_id", F.round("t.score", 6).alias("score"), "t.clauses", "t.toxic")


def without_toxic(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that aren't rejected; see toxic_documents."""
    learned = () if labels is None else learned_insults(docs, labels)
    return small_batches(docs).where(~toxicity_of("text", learned)["toxic"])
