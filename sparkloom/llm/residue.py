"""Template residue and error-page text, by positive-unlabelled naive Bayes with expectation-maximization.

A record is cut down to its author's own text: quotes of others (bracket tags, blockquote tags, lines behind quote
marks with their attribution), a signature behind a delimiter line, and what is shown as code are taken out. A line
of ``--`` begins a signature of any length; behind the other delimiter lines (``---``, ``***``, ``___``, ``~~~``,
``===``), which may also part a text, a signature is one block of lines without a blank one.

The own text is a sequence of tokens that falls into passages: sentences, lines, and a placeholder with the two tokens
on either side. Passages that show the syntax of an unfilled template, hold a seed wording of error pages, script
notices or filler (``SEEDS``), or say few words over and over, and in which no person speaks or asks, are the trusted positives;
all others are unlabelled. Trust only labels: the decision on every passage is the model's.

The model is a naive Bayes whose words depend on the class and the word before (chain-augmented, so a fixed phrase
counts as often as its words and not once more for each pair). Both classes are smoothed towards all passages by
shares, not counts, so it behaves alike at every size. It starts with the unlabelled as negative; each round of
expectation-maximization re-estimates both classes from the passages' current probabilities, until the expected number
of cases stands still. While it learns, a passage beside a likely one has a higher prior, so that the other sentences of
an error page teach their words too; the decision uses no such prior. A record counts as residue if any passage does.

``held_out`` measures what the model knows by itself: it hides the labels of a share of the trusted wordings from the
fit and gives the part of their passages that is found all the same.

Scale: tokens are made once in Arrow batches and written to the shared folder as one list of numbers per record. A
round is one pass over them without a shuffle of records: each batch is scored with numpy and gives back its expected
counts, which are summed. The model has ``WORDS + PAIRS`` entries whatever the corpus, so what goes to the driver
and back has a fixed bound. All counts cover all records. The rounds run when the query is built.

Defined results: null and empty texts are no residue; texts of quotes or signature alone are none; repeated
records are each decided alike; a null key is kept as null; without any trusted passage nothing is found; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import warnings
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut, source_bytes

#: Sizes of the hashed spaces of words and of pairs of words, and so of the model.
WORDS, PAIRS = 1 << 18, 1 << 19
#: Texts whose tokens are held at a time.
TEXTS_AT_ONCE = 2_000
#: Rounds after which an estimate that has not come to rest is reported by a warning.
ROUNDS = 40
#: Relative change of the expected number of cases at which the rounds end.
STANDSTILL = 1e-3
#: Weight of an unlabelled passage's probability in the counts of the positive class.
UNLABELLED_WEIGHT = 0.35
#: Share of all passages' words in a class's words, and least share of a class's words in those behind a word.
WORD_SHARE, PAIR_SHARE = 0.1, 0.3
#: Occurrences of a word, per passage of the class, at which the words behind it count half.
HALF_KNOWN = 0.05
#: Probability that a passage beside a residue passage is one, while the model learns.
NEIGHBOUR = 0.3
THRESHOLD = 0.9
#: Bytes of tokens that a task of a round reads at least.
TASK_BYTES = 1 << 28

_QUOTE_TAG = re.compile(r"\[(/?)(quote)(?:=[^\]\n]*)?\]|<(/?)(blockquote)\b[^>\n]*>", re.IGNORECASE)
_ATTRIBUTION = re.compile(r"^[^\s>][^\n]*\b(?:wrote|writes|said|schrieb|a écrit|escribió):[ \t]*$")
_SIGNATURE = re.compile(r"^(?:-{2,3}|~{3,}|_{3,}|={3,}|\*{3,})[ \t]*$")
_CODE = re.compile(r"<code\b[^>]*>.*?(?:</code>|\Z)|\[code\].*?(?:\[/code\]|\Z)|```.*?(?:```|\Z)|`[^`\n]*`", re.IGNORECASE | re.DOTALL)
_BREAK = re.compile(r"<br\s*/?>|</?p>|</?div[^>]*>", re.IGNORECASE)
_MARKUP = re.compile(r"</?(?:b|i|u|s|em|strong|span|font)\b[^>]*>|\[/?(?:b|i|u|s|url|color|size)(?:=[^\]\n]*)?\]|\[img\].*?\[/img\]", re.IGNORECASE)

# Syntaxes of placeholders that template languages leave behind; names may have any length.
_SLOTS = (
    r"\{\{\s*[A-Za-z][^{}\n]*\}\}",
    r"[$#]\{\s*[A-Za-z][^{}\n]*\}",
    r"<%=?\s*[A-Za-z][^%<>\n]*%>",
    r"%\([A-Za-z][\w.-]*\)[sd]",
    r"%[A-Za-z][\w.-]*%|%%[A-Za-z][\w.-]*%%",
    r"@@[A-Za-z][\w.-]*@@",
    r"\*\|[A-Za-z][\w:.-]*\|\*",
    r"(?<!\w)__[A-Za-z][A-Za-z0-9_.-]*?__(?!\w)",
    r"\#\#[A-Za-z][\w.-]*\#\#",
    r"\[\[\s*[A-Za-z][^\[\]\n]*\]\]",
    r"<(?i:insert|enter|add|your)\s[^<>\n]+>|\[(?i:insert|enter|add|your)\s[^\[\]\n]+\]|\((?i:insert)\s[^()\n]+\s(?i:here)\)",
    r"\[(?!(?:sic|edit|edited|deleted|removed|solved|closed|quote|code|img|url|list|spoiler|size|color|table|video)\])[a-z]{3,}[a-zA-Z]*(?:[._-][a-zA-Z]+)*\]",
    r"(?<![\w{$\#\\])\{[A-Za-z]{3}[\w.-]*\}(?!\})",
)
_TOKEN = re.compile(
    rf"[^\W\d_]+(?:'[^\W\d_]+)?|\#?\d+|\n|(?=[{{$\#<%@*_\[(])(?:{'|'.join(_SLOTS)}|</?[A-Za-z]\w*>?)|[.!?…]+(?=\s|\Z)|[?!:]|\x00"
)

# Seed wordings. Words are in lower case; ``|`` parts alternatives, ``<4xx>`` is a number of
# ``STATUSES``, ``^`` and ``$`` are the ends of a passage.
SEEDS = (
    # notices that scripts are required, in the boards' languages
    "enable|activate|allow|permit javascript|js|scripts|scripting",
    "turn|switch on javascript|js|scripts|scripting",
    "javascript|js|scripts|scripting is|are required|needed|disabled|blocked",
    "javascript|js|scripts|scripting has|have been disabled|blocked",
    "javascript|js|scripts|scripting seems|appears to be off|disabled|blocked",
    "requires javascript|js|scripts|scripting",
    "^ content blocked",
    "not support|run javascript|js|scripts|scripting",
    "aktivieren|erlauben sie javascript",
    "activer|autoriser javascript",
    "active|habilite|permita javascript",
    # error pages
    "^ <4xx> bad|not|forbidden|gone|internal|service|gateway|unauthorized|too|request",
    "error|erreur|fehler|http <4xx>",
    "<title> <4xx>",
    "^ page not found $",
    "page cannot|could|is|was be|not|moved|deleted|removed found|displayed|available|or",
    "page you requested|tried|are|were",
    "^ access denied|forbidden|refused $",
    "^ service unavailable|offline $",
    "service temporarily unavailable|offline",
    "^ too many requests",
    "something went wrong",
    "down for maintenance",
    "^ your session has expired|ended",
    "^ seite nicht gefunden",
    "^ zugriff verweigert",
    "^ page introuvable",
    "^ página no encontrada",
    # filler
    "lorem|ipsum|dolor lorem|ipsum|dolor|amet",
    "^ sample|dummy|filler|placeholder|example text|paragraph|content $",
    "text|content goes here",
    "content coming|will soon|be",
    "^ add|enter|insert|paste|type your content|description|heading|message|post|text|title",
    "^ replace this text|paragraph",
    "^ todo :",
    "^ beispieltext|blindtext|platzhaltertext $",
    "^ texto de ejemplo|relleno|prueba $",
    "^ texte de remplissage $",
    "^ inhalt folgt",
)
# Words of a person who speaks.
PERSON = "i my me mine i'm i've i'd ich mein meine meinem meinen mir je j'ai mon ma mes yo mi mis their theirs ?"

# HTTP status numbers of errors.
STATUSES = frozenset(map(str, (*range(400, 419), *range(421, 430), 431, 451, *range(500, 512))))

#: Ends of passages: of a sentence or line, and beside a placeholder; end of a question or call, placeholder, run of one letter, code.
EDGE, CUT, ASKED, CALLED, SLOT, RUN, CODE, STATUS = range(8)
_FIRST = 8


def without_quotes(text: str) -> str:
    """The text without quotes of others.

    A quote tag reaches to its match (tags of the other kind inside don't count), to the last closing tag if
    none matches, or to the next blank line if there is none. Outside of tags a line behind a quote mark is
    quoted, and the line before it that names who wrote it goes with it.
    """
    if ">" not in text and "[" not in text:
        return text
    out: list[str] = []
    at, end = 0, len(text)
    line_start = True
    while at < end:
        stop = text.find("\n", at)
        stop = end if stop < 0 else stop
        if line_start and text[at:stop].lstrip().startswith(">"):
            if out:
                held = "".join(out).rstrip("\n")
                head, _, last = held.rpartition("\n")
                if _ATTRIBUTION.match(last):
                    out = [head, "\n"] if head else []
            at, line_start = stop + 1, True
            continue
        tag = _QUOTE_TAG.search(text, at, stop)
        if tag is None:
            out.append(text[at:stop] + "\n")
            at, line_start = stop + 1, True
            continue
        out.append(text[at : tag.start()])
        if tag.group(1) or tag.group(3):
            at, line_start = tag.end(), False
            continue
        kind, depth, last, close = (tag.group(2) or tag.group(4)).lower(), 1, None, None
        for other in _QUOTE_TAG.finditer(text, tag.end()):
            if (other.group(2) or other.group(4)).lower() != kind:
                continue
            if other.group(1) or other.group(3):
                depth, last = depth - 1, other.end()
                if not depth:
                    close = last
                    break
            else:
                depth += 1
        if close is None:
            blank = text.find("\n\n", tag.end())
            close = last if last is not None else end if blank < 0 else blank
        out.append("\n")
        at, line_start = close, False
    return "".join(out)


def own_text(text: str | None) -> str:
    """What the author says: quotes, signature and shown code taken out."""
    if not text:
        return ""
    lines = without_quotes(text).rstrip().split("\n")
    one_block = True
    for k in range(len(lines) - 1, -1, -1):
        if one_block and _SIGNATURE.match(lines[k]) or lines[k].rstrip(" \t") == "--":
            lines = lines[:k]
            break
        one_block = one_block and bool(lines[k].strip())
    own = "\n".join(lines)
    return _CODE.sub(" \x00 ", own) if "`" in own or "code" in own or "CODE" in own else own


class _Known(dict):
    """Numbers of tokens; numbers of one length are one word, and so are runs of one letter."""

    def __missing__(self, token: str) -> int:
        self[token] = n = self._number(token)
        return n

    @staticmethod
    def _number(token: str) -> int:
        first, w = token[0], token.lower()
        if first in "\n.…":
            return EDGE
        if first in "?!" and token != "?!":
            return ASKED if "?" in token else CALLED
        if first == "\x00":
            return CODE
        if token[-1].isdigit():
            if token in STATUSES:
                return STATUS
            w = f"{first if first == '#' else ''}{len(token)}"
        elif len(token) > 2 and w == w[0] * len(w):
            return RUN
        elif first in "{$#%@*_[(" or first == "<" and not re.fullmatch(r"</?[A-Za-z]\w*>?", token):
            return SLOT
        return word_number(w)


def word_number(word: str) -> int:
    """The number of a word in lower case."""
    return _FIRST + zlib.crc32(word.encode()) % (WORDS - _FIRST)


def _table_of(words: Iterable[int]) -> np.ndarray:
    has = np.zeros(WORDS, dtype=bool)
    has[list(words)] = True
    return has


_NAMED = {"^": EDGE, "$": EDGE, "<4xx>": STATUS, "?": ASKED}
_SEED_TABLES = [[_table_of(_NAMED.get(w, word_number(w)) for w in part.split("|")) for part in seed.split()] for seed in SEEDS]
_PERSON_TABLE = _table_of(_NAMED.get(w, word_number(w)) for w in PERSON.split())


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in a row and how many each text has.

    Each passage ends in EDGE or CUT; the end of a trusted one is stored as ``-1 - end``.
    """
    known, flat, sizes = _Known(), [], []
    for text in texts:
        plain = own_text(text)
        if "<" in plain or "[" in plain:
            plain = _MARKUP.sub(" ", _BREAK.sub("\n", plain))
        if "&" in plain:
            plain = html.unescape(plain)
        before = len(flat)
        flat.extend(map(known.__getitem__, _TOKEN.findall(plain)))
        flat.append(EDGE)
        sizes.append(len(flat) - before)
    tokens = np.array(flat, dtype=np.int32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    tokens, owner = _with(tokens, owner, np.flatnonzero((tokens == ASKED) | (tokens == CALLED)), EDGE)
    edge = tokens == EDGE
    first = np.r_[True, owner[1:] != owner[:-1]]
    kept = ~(edge & (first | np.r_[False, edge[:-1]]))
    tokens, owner = tokens[kept], owner[kept]
    slot = tokens == SLOT
    if slot.any():
        near, inside = slot, tokens != EDGE
        for _ in range(2):
            near = inside & (near | np.r_[near[1:], False] | np.r_[False, near[:-1]])
        parts = np.flatnonzero((near[1:] != near[:-1]) & inside[1:] & inside[:-1])
        tokens, owner = _with(tokens, owner, parts, CUT)
    if len(tokens):
        ends = np.flatnonzero(tokens <= CUT)
        trusted = ends[_trusted(tokens, owner, ends)]
        tokens[trusted] = -1 - tokens[trusted]
    return tokens, np.bincount(owner, minlength=len(sizes))


def _with(tokens: np.ndarray, owner: np.ndarray, behind: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
    """With a token more behind the places given."""
    return np.insert(tokens, behind + 1, token), np.insert(owner, behind + 1, owner[behind])


def _trusted(tokens: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per passage whether it is a certain case: template syntax, seed wording, few words over and over."""
    starts = np.r_[0, ends[:-1] + 1]
    passage = np.repeat(np.arange(len(ends)), ends - starts + 1)
    slot = np.logical_or.reduceat(tokens == SLOT, starts)
    person = np.logical_or.reduceat(_PERSON_TABLE[tokens], starts)
    seeded = np.zeros(len(ends), dtype=bool)
    sequence = np.r_[np.int32(EDGE), tokens]
    for parts in _SEED_TABLES:
        at = np.flatnonzero(parts[0][sequence[: len(sequence) - len(parts) + 1]])
        for k, part in enumerate(parts[1:], 1):
            at = at[part[sequence[at + k]]]
        seeded[passage[at + (parts[0][EDGE] and 1 or 0) - 1]] = True
    word = (tokens >= _FIRST) | (tokens == RUN) | (tokens == STATUS)
    words = np.add.reduceat(word.astype(np.int64), starts)
    long = word & (words >= 8)[passage]
    kinds = np.sort(passage[long] * np.int64(WORDS) + tokens[long])
    distinct = np.bincount(kinds[np.r_[True, kinds[1:] != kinds[:-1]][: len(kinds)]] // WORDS, minlength=len(ends))
    monotone = (words >= 8) & (2 * distinct <= words)
    place = np.arange(len(tokens)) - starts[passage]
    same = np.add.reduceat((tokens.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), starts)
    texts = np.flatnonzero(np.r_[True, owner[ends][1:] != owner[ends][:-1]])
    counts = np.diff(np.r_[texts, len(ends)])
    repeats = np.repeat((counts > 3) & (np.minimum.reduceat(same, texts) == np.maximum.reduceat(same, texts)), counts) & (words > 1)
    return slot | ((seeded | monotone | repeats) & ~person)


@dataclass
class Passages:
    """The passages of a batch of records: tokens, the tokens before them, and per passage start, trust, record and kind."""

    tokens: np.ndarray
    pairs: np.ndarray
    before: np.ndarray
    starts: np.ndarray
    trusted: np.ndarray
    record: np.ndarray
    slot: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, sizes: np.ndarray) -> Passages:
        trust = tokens < 0
        plain = np.where(trust, -1 - tokens, tokens)
        ends = np.flatnonzero(plain <= CUT)
        starts = np.r_[0, ends[:-1] + 1].astype(np.int64)[: len(ends)]
        before = np.r_[np.int32(EDGE), plain[:-1]][: len(plain)]
        pairs = ((before.astype(np.uint64) * np.uint64(0x9E3779B1) ^ plain.astype(np.uint64)) * np.uint64(0x85EBCA6B) >> np.uint64(13)) % np.uint64(PAIRS)
        record = np.repeat(np.arange(len(sizes)), sizes)[ends]
        slot = np.logical_or.reduceat(plain == SLOT, starts) if len(ends) else np.empty(0, dtype=bool)
        return cls(plain, pairs.astype(np.int64), before, starts, trust[ends], record, slot)

    def __len__(self) -> int:
        return len(self.starts)

    def hidden(self, share: float) -> np.ndarray:
        """The trusted passages whose wording belongs to a share of all wordings."""
        if not len(self) or not share:
            return np.zeros(len(self), dtype=bool)
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, np.diff(np.r_[self.starts, len(self.tokens)]))
        mixed = (self.tokens.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        wording = np.add.reduceat(mixed, self.starts) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
        return self.trusted & (wording < np.uint64(int(share * (1 << 24))))

    def beside(self, probability: np.ndarray) -> np.ndarray:
        """The greater probability of the neighbours in the same record; those around a placeholder say nothing of the rest of their sentence."""
        p = np.where(self.slot, 0.0, probability)
        same = self.record[1:] == self.record[:-1]
        return np.maximum(np.r_[0.0, np.where(same, p[:-1], 0.0)], np.r_[np.where(same, p[1:], 0.0), 0.0]) * ~self.slot


class NaiveBayes:
    """Log odds of a passage from expected counts of words and pairs of words in either class."""

    def __init__(self, positive: np.ndarray, negative: np.ndarray):
        total = positive + negative
        share = (positive[-1] + 1) / (total[-1] + 2)
        self.share = float(share)
        overall = (total[:WORDS] + 1e-3) / (total[:WORDS].sum() + 1e-3 * WORDS)
        self.sides = []
        for counts in (positive, negative):
            words, pairs = counts[:WORDS], counts[WORDS:-1]
            single = (1 - WORD_SHARE) * words / max(words.sum(), 1e-9) + WORD_SHARE * overall
            half = HALF_KNOWN * max(words[EDGE] + words[CUT], 1.0)
            back = np.maximum(PAIR_SHARE, half / (words + half))
            self.sides.append([x.astype(np.float32) for x in (single, back, (1 - back) / np.maximum(words, 1e-9), pairs)])

    def evidence(self, batch: Passages) -> np.ndarray:
        """Log likelihood ratio per passage."""
        if not len(batch):
            return np.empty(0)
        logs = [np.log(ahead[batch.before] * pairs[batch.pairs] + back[batch.before] * single[batch.tokens]) for single, back, ahead, pairs in self.sides]
        return np.add.reduceat(logs[0].astype(np.float64) - logs[1], batch.starts)

    def probabilities(self, batch: Passages) -> np.ndarray:
        """Of being residue, from the passage's own words."""
        return _posterior(self.evidence(batch), np.full(len(batch), self.share))



def _learning(model: NaiveBayes | None, batch: Passages, trusted: np.ndarray) -> np.ndarray:
    """Probabilities with trusted passages at 1 and the others' prior raised beside likely passages."""
    evidence, share = (model.evidence(batch), model.share) if model else (np.zeros(len(batch)), 0.0)
    first = np.where(trusted, 1.0, _posterior(evidence, np.full(len(batch), share)))
    beside = batch.beside(first)
    return np.where(trusted, 1.0, _posterior(evidence, share * (1 - beside) + NEIGHBOUR * beside))


def _posterior(evidence: np.ndarray, prior: np.ndarray) -> np.ndarray:
    prior = np.maximum(prior, 1e-300)
    return 1 / (1 + np.exp(-np.clip(evidence + np.log(prior) - np.log1p(-prior), -700, 700)))


def add_counts(positive: np.ndarray, negative: np.ndarray, batch: Passages, model: NaiveBayes | None, hide: float, weight: float) -> None:
    """Add a batch's expected counts of words, pairs and, as last entry, passages."""
    if not len(batch):
        return
    trusted = batch.trusted & ~batch.hidden(hide)
    p = _learning(model, batch, trusted)
    for counts, share in ((positive, np.where(trusted, 1.0, weight * p)), (negative, 1 - p)):
        per_token = np.repeat(share, np.diff(np.r_[batch.starts, len(batch.tokens)]))
        counts[:WORDS] += np.bincount(batch.tokens, per_token, WORDS)
        counts[WORDS:-1] += np.bincount(batch.pairs, per_token, PAIRS)
        counts[-1] += share.sum()


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values in a row and lengths of a column of lists."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False), np.diff(chunk.offsets.to_numpy())


def token_table(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens (as of ``encoded``) of every record with text."""
    kind = documents.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                tokens, sizes = encoded(part.column(1).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32()))], ["_key", "tokens"])

    chosen = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull() & (F.col("_text") != ""))
    return chosen.mapInArrow(make, f"_key {kind}, tokens array<int>")


def _expected(table: DataFrame, model: NaiveBayes | None, hide: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of both classes per entry of the model."""
    size = WORDS + PAIRS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positive, negative = np.zeros(size), np.zeros(size)
        for batch in batches:
            add_counts(positive, negative, Passages.of(*_lists(batch.column(0))), model, hide, weight)
        seen = np.flatnonzero(positive + negative)
        yield pa.RecordBatch.from_pydict({"entry": seen.astype(np.int32), "positive": positive[seen], "negative": negative[seen]})

    spark = table.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, source_bytes(table) // TASK_BYTES)  # each gives off as many rows as the model has entries at most
    counts = table.select("tokens").coalesce(tasks).mapInArrow(count, "entry int, positive double, negative double")
    got = counts.groupBy("entry").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")).toPandas()
    positive, negative = np.zeros(size), np.zeros(size)
    positive[got["entry"]], negative[got["entry"]] = got["positive"], got["negative"]
    return positive, negative


def fit(table: DataFrame, rounds: int = ROUNDS, hide: float = 0.0, weight: float = UNLABELLED_WEIGHT) -> NaiveBayes | None:
    """Expectation-maximization over all passages until the expected number of cases stands still; None if none is trusted.

    The labels of a share ``hide`` of the trusted wordings are not used.
    """
    model, before = None, 0.0
    for _ in range(rounds):
        positive, negative = _expected(table, model, hide, weight)
        if not positive[-1]:
            return None
        model = NaiveBayes(positive, negative)
        if abs(positive[-1] - before) <= STANDSTILL * positive[-1]:
            return model
        before = positive[-1]
    if rounds > 1:
        warnings.warn(f"the estimate has not come to rest in {rounds} rounds", stacklevel=2)
    return model


def held_out(table: DataFrame, hide: float = 1 / 3, threshold: float = THRESHOLD) -> dict[str, int]:
    """What the model finds without its labels: of a share ``hide`` of the trusted wordings the passages, and those found."""
    model = fit(table, hide=hide)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hidden = found = 0
        for batch in batches:
            passages = Passages.of(*_lists(batch.column(0)))
            chosen = passages.hidden(hide)
            hidden += int(chosen.sum())
            found += int((chosen & (model.probabilities(passages) >= threshold)).sum()) if model else 0
        yield pa.RecordBatch.from_pydict({"hidden": [hidden], "found": [found]})

    sums = table.select("tokens").mapInArrow(judge, "hidden long, found long").agg(F.sum("hidden"), F.sum("found")).first()
    return {"hidden": sums[0] or 0, "found": sums[1] or 0}


def score(table: DataFrame, model: NaiveBayes | None, threshold: float = THRESHOLD) -> DataFrame:
    """_key, probability of the likeliest passage, residue_passages at or above the threshold, for every record that has a passage."""
    kind = table.schema["_key"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes = _lists(batch.column(1))
            passages = Passages.of(tokens, sizes)
            p = model.probabilities(passages) if model else np.zeros(len(passages))
            best, over = np.zeros(len(sizes)), np.bincount(passages.record[p >= threshold], minlength=len(sizes))
            np.maximum.at(best, passages.record, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(over, pa.int64())], ["_key", "probability", "residue_passages"])

    return table.select("_key", "tokens").mapInArrow(judge, f"_key {kind}, probability double, residue_passages long")


def residue_records(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Records with residue: key, probability of the likeliest passage, number of passages at or above the threshold.

    Rows that share a key come out as one.
    """
    table = cut(token_table(documents, key, text))
    return (
        score(table, fit(table), threshold)
        .where(F.col("residue_passages") > 0)
        .groupBy(F.col("_key").alias(key))
        .agg(F.max("probability").alias("probability"), F.sum("residue_passages").alias("residue_passages"))
    )
