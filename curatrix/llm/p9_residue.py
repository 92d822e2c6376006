"""Problem 9: template residue, filler and error-page text in place of content.

A regularised linear classifier over hashed n-grams, length and title features scores every segment (sentence or line)
of a text; a text is reported if one of its segments scores ``THRESHOLD`` or more. The score alone decides.

It is trained on weak labels: response-status lines, general phrases of error, access and script pages, the syntax of
template languages, and the plainest kinds of filler. Segments that hold a word of those labels without being labelled
are kept as contrasts beside a sample of other segments, so the classifier learns in which surroundings such words are
content. Unlabelled segments need not be content: each half of them is scored by a fit on the labelled ones and the other
half, and what scores above ``DOUBT`` is left out of the last fit. A labelled sentence without its placeholder is content
too. The classifier adds what shares its words, order or shape with the labelled segments (mock Latin that never says "lorem
ipsum", page sentences that no phrase lists, placeholders of other bracket styles) and drops labelled wording that also
stands in content. It is validated on sources (hosts) that it has not seen.

Features of a segment: words, pairs and triples of tokens, with marks for its start and end; shapes of three to five
tokens (capitals, small letters, digits, the punctuation itself) around punctuation; its length; whether it is the first
or the only one of its text; whether it ends like a sentence (a title does not); how many of its words differ.

Training rows are a bounded sample, at most ``SAMPLE`` distinct contrasts, ``SAMPLE`` other segments and ``LABELLED``
labelled ones, chosen by hash, labelled ones evenly over phrases, status codes, placeholder styles and the like; it does not
thin out with the number of texts. A label with more than ``EVEN`` segments in it weighs as one with ``EVEN``, so that
sentences with placeholders, which grow with the texts, do not outweigh phrases, which do not. Scoring covers every
segment of every text. Nothing is shuffled but the sample.

Cases: null, empty and blank texts hold nothing; texts in other languages, markup, mathematical braces and tokenizer
marks are ordinary; a source may be null; repeated texts give a row each; if the sample has no segment of one label,
as in an empty table, nothing is reported; very long texts are scored segment by segment to the end. Extra columns are
ignored; needed are doc_id, text and source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.balance import ordinals
from curatrix.plans.stages import keep_keys, materialize

#: Training segments of each unlabelled kind and labelled ones at most, hashed features, steps and strength of regularisation.
SAMPLE, LABELLED, BITS, STEPS, RIDGE = 10_000, 20_000, 18, 100, 1e-6
#: Score from which a segment counts.
THRESHOLD = 0.95
#: Unlabelled training segments that a fit on the other half scores above this are taken out before the last fit.
DOUBT = 0.3
#: Labelled segments of so many words at most are sampled apart from longer ones of the same label.
SHORT = 6
#: Training segments of one label weigh as so many together, however many more they are.
EVEN = 100
#: Texts scored at once.
BLOCK = 400

_LINE = re.compile(r"[\r\n]+")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_LEAD = re.compile(r"^(?:[ \t>*]*(?:note|fig(?:ure|\.)?[ \t]*\d+)[ \t]*[.:][ \t]*|[ \t>*]+)+", re.I | re.M)
_MARKS = re.compile(r"<\|\w+\|>")
_TOKEN = re.compile(r"\n|[^\W\d_]+|\d+|_+|[^\w\s]")

# Placeholder syntax of common template languages and of forms, a group for each.
_FIELD = re.compile(
    r"""((?<![_^\\$\w])\{[ ]?[A-Za-z][A-Za-z_ ]{2,30}\}(?![$\w])) | (\{\{[^{}\n]{1,40}\}\}) | (\{%[^{}\n]{1,40}%\}) | (\$\{[^{}\n]{1,40}\}) | (<%=?[^<>\n]{1,40}%>) | (%\(\w{1,40}\)[sdf])
    | (\[\[[^\[\]\n]{1,40}\]\]) | (<<[^<>\n]{1,40}>>) | («[^«»\n]{1,40}») | (@@\w{1,40}@@) | (__[A-Z][A-Z_]{1,40}__) | (\#[A-Z][A-Z_]{2,40}\#) | ([\[<](?:insert|enter|your|add)[ _][^\]>\n]{1,40}[\]>]) | ([\[<][^\[\]<>\n]{0,40}\b(?:goes[ ]here|fill[ ]in)[\]>])
    | (\b(?:TODO|FIXME)\b) | (\bTBD\b) | (\[object[ ]Object\]) | (\bundefined[ ]undefined\b) | (\bXX+-(?:year|day|month))""",
    re.X | re.I,
)
_FIELD_HINT = re.compile(r"[{\[<@%«#_]")
# Status lines of responses, in lower case.
_STATUS = re.compile(
    r"""<title>\s*[45]\d\d\b | "status"\s*:\s*[45]\d\d\b | ^\W*(?:http\s)?(?:error\s)?[45]\d\d\W{0,3}\s?(?:bad|unauthorized|forbidden|not|method|gone|too|internal|service|gateway)\b | ^\W*(?:http\s)?error\s[45]\d\d\b""", re.X
)
# General phrases, in words, of error, access and script pages and of unwritten pages; ^ is the start.
_PHRASES = (
    *(f"{v} {t}" for v in ("enable", "activate", "allow", "turn on", "requires", "require", "needs", "need") for t in ("javascript", "js", "scripts", "cookies")),
    *(f"{t} {v}" for t in ("javascript", "scripts", "cookies") for v in ("is disabled", "is required", "must be enabled", "must be switched", "must be turned", "must be on", "is not enabled", "is turned off", "required")),
    "^noscript", "your browser does", "your browser is", "your browser has", "^checking your browser", "^access denied", "^permission denied", "you do not have permission", "you do not have access", "you are not authorized", "you are not authorised",
    "^page not found", "^the page was not found", "can t find that page", "can t find the page", "can t find this page", "cannot find the page", "your session has", "please log in", "please sign in", "something went wrong", "request timed out", "connection timed out",
    "try again later", "down for maintenance", "not available in your", "^internal server error", "^traceback most recent call", "^invalid token", "^missing token", "^invalid request", "^invalid credentials", "contact the site owner",
    "contact the administrator", "contact the system administrator", "back to the home page", "back to home page", "lorem ipsum", "^coming soon", "^under construction", "will be added later", "to be supplied", "to be added", "to be completed", "your text here", "your title here",
    "your caption here", "^click to edit", "^click here to edit", "^click to add", *(f"^{v} {a}{t}" for v in ("enter", "type", "add", "insert") for a in ("", "a ", "the ", "your ") for t in ("text", "title", "description", "caption")),
    "dummy text", "placeholder text", "^this is a dummy", "^this is a placeholder", "check back later", "check back soon", "left blank", "no content yet",
    "page introuvable", "page non trouvée", "accès refusé", "accès interdit", "activer javascript", "activez javascript", "veuillez vous connecter", "veuillez réessayer", "erreur du serveur", "erreur interne du serveur", "votre navigateur", "votre texte ici",
    "seite nicht gefunden", "seite wurde nicht gefunden", "zugriff verweigert", "aktivieren sie javascript", "javascript aktivieren", "melden sie sich", "serverfehler", "ihr browser", "text eingeben", "text hier eingeben",
    "página no encontrada", "acceso denegado", "active javascript", "activar javascript", "inicie sesión", "error del servidor", "error interno del servidor", "inténtelo", "su navegador", "aquí su texto", "aquí el texto",
)
_BY_WORD: dict[str, list[str]] = {}
for _phrase in _PHRASES:
    _BY_WORD.setdefault(max(_phrase.strip("^").split(), key=len), []).append(_phrase.replace("^", "^ ") + " " if _phrase[0] == "^" else f" {_phrase} ")
# Bare marks of unwritten text, and raw output of a program that failed.
_BARE = frozenset("todo fixme tbd undefined object xx xxx".split())
_RAW = re.compile(r"""^\W*(?:file\s"[^"]+",\sline\s\d+|[a-z]+(?:error|exception):\s)""", re.I)
#: Words without which no phrase or mark is looked for, and which make an unlabelled segment a contrast.
_KEYS = frozenset(_BY_WORD) | _BARE
# What people type to fill a field.
_TYPED = frozenset("asdf qwerty blah bla foo bar baz xxx test lorem ipsum".split())
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CODES = frozenset(map(str, range(400, 600)))


def segments(text: str | None) -> list[str]:
    """Sentences of each line; a piece of under three words (an abbreviation, a number) stays with the one after it."""
    out: list[str] = []
    for line in _LINE.split(text or ""):
        held = ""
        for part in _SENTENCE.split(line):
            held = f"{held} {part}" if held else part
            if len(held.split(None, 3)) > 2:
                out.append(held)
                held = ""
        if held.strip():
            out.append(held)
    return out


def bare(segment: str) -> str:
    """A segment on one line, without a leading figure number, note mark or quotation mark."""
    return _LEAD.sub("", " ".join(segment.split()))


def _filler(words: list[str]) -> bool:
    """At least four words that are mostly typed filler, or one or two words over and over."""
    if len(words) < 4:
        return False
    kinds = len(set(words))
    return kinds <= 2 and len(words) >= 2 * kinds and words[0].isalpha() or not _TYPED.isdisjoint(words) and sum(w in _TYPED for w in words) >= 0.6 * len(words)


def sort_of(segment: str) -> tuple[int, str]:
    """(kind, what a label rests on). Kind 2: weakly labelled (response status, general phrase, placeholder syntax or plain
    filler); 1: a contrast, which holds what a label starts from; 0: another segment."""
    words = _WORD.findall(segment.lower())
    size = "short" if len(words) <= SHORT else "long"
    if _filler(words):
        return 2, f"{size} filler"
    keys = _KEYS.intersection(words)
    hint = bool(_FIELD_HINT.search(segment))
    if (hint or not _BARE.isdisjoint(keys)) and (field := _FIELD.search(segment)):
        return 2, f"{size} field {field.lastindex}"
    if ('"' in segment or ":" in segment) and _RAW.search(segment):
        return 2, f"{size} raw"
    if keys:
        line = f"^ {' '.join(_WORD.findall(bare(segment).lower()))} "
        if said := [phrase for k in keys for phrase in _BY_WORD.get(k, ()) if phrase in line]:
            return 2, f"{size} phrase {min(said)}"
    codes = _CODES.intersection(words)
    if codes and _STATUS.search(bare(segment).lower()):
        return 2, f"{size} status {min(codes)}"
    return int(hint or bool(codes) or bool(keys)), ""


def kind_of(segment: str) -> int:
    return sort_of(segment)[0]


def weak_label(segment: str) -> bool:
    return kind_of(segment) == 2


class _Ids:
    """Hashes of tokens and of their shapes, remembered up to a fixed number. A token is taken in lower case, a number as 0;
    its shape is its case, "0" or the mark itself."""

    def __init__(self, keep: int = 300_000):
        self.keep, self.number = keep, {}
        self.values, self.size = np.zeros((2, 1 << 12), np.uint64), 0

    def look(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, shapes); the lowest bit of a shape says punctuation, the second one a word."""
        if self.size > self.keep:
            self.number, self.size = {}, 0
        number = self.number
        for t in set(tokens).difference(number):
            first = t[0]
            plain, shape, kind = ("0", "0", 0) if t.isdigit() else (t.lower(), "A" if t.isupper() and len(t) > 1 else "a", 2) if first.isalpha() else (t[:2], t[:2], int(t != "\n"))
            if self.size == self.values.shape[1]:
                self.values = np.concatenate([self.values, np.zeros_like(self.values)], 1)
            self.values[:, self.size] = xxhash.xxh3_64_intdigest(plain) & 0x7FFFFFFFFFFFFFFF, xxhash.xxh3_64_intdigest(shape, 5) & 0x7FFFFFFFFFFFFFFC | kind
            number[t] = self.size
            self.size += 1
        at = np.array([number[t] for t in tokens], np.int64)
        return self.values[0][at], self.values[1][at]


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def features(rows: list[tuple[str, bool, bool]], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each feature, hashed feature) of rows (segment, is the first of its text, is the only one)."""
    text = "\n" + "\n".join([s for s, _, _ in rows]) + "\n"
    if "<|" in text:
        text = _MARKS.sub(" ", text)
    token, shape = ids.look(_TOKEN.findall(_LEAD.sub("", text)))
    edge = token == token[0]
    row = np.cumsum(edge) - 1
    n = len(rows)
    found, owner = [], []

    def grams(values: np.ndarray, length: int, salt: int, keep: np.ndarray | None = None) -> None:
        """Runs of ``length`` tokens within a segment, its edges included."""
        last = len(values) - length + 1
        if last <= 0:
            return
        # The one before the last token is of the same segment as the first, so only the last can be the next edge.
        at = np.flatnonzero(row[:last] == row[length - 2 : length - 2 + last]) if length > 1 else np.flatnonzero(~edge)
        if keep is not None:
            at = at[keep[at]]
        total = values[at] * _M1 + np.uint64(salt)
        for k in range(1, length):
            total = _mixed(total) + values[at + k]
        found.append(_mixed(total))
        owner.append(row[at])

    for length in (1, 2, 3):
        grams(token, length, length)
    marks = np.cumsum(np.append(0, (shape & np.uint64(1)).astype(np.int64)))
    for length in (3, 4, 5):
        last = max(0, len(shape) - length + 1)
        # Shapes matter where two of the tokens are punctuation, as brackets are.
        grams(shape, length, 10 + length, marks[length : length + last] - marks[:last] >= 2)
    size = np.bincount(row[~edge], minlength=n)[:n]
    word = np.flatnonzero((shape & np.uint64(2)) > 0)
    words = np.bincount(row[word], minlength=n)[:n]
    each = np.sort((row[word].astype(np.uint64) << np.uint64(40)) | (token[word] >> np.uint64(24)))
    kinds = np.bincount((each[np.flatnonzero(np.append(True, each[1:] != each[:-1]))[: len(each)]] >> np.uint64(40)).astype(np.int64), minlength=n)[:n]
    # The last token before the next edge says whether the segment ends like a sentence.
    ends = np.flatnonzero(edge)[1:][:n] - 1
    stopped = (shape[ends] & np.uint64(1)) > 0
    first, only = np.array([f for _, f, _ in rows]), np.array([o for _, _, o in rows])
    long = np.minimum(np.ceil(np.log2(size + 1)), 8).astype(np.int64)
    varied = (8 * kinds // np.maximum(words, 1)) * 16 + np.minimum(words, 12)
    for salt, value in ((20, long), (21, long * 4 + first * 2 + only), (22, long * 2 + stopped), (23, varied)):
        found.append(_mixed(value.astype(np.uint64) * _M3 + np.uint64(salt)))
        owner.append(np.arange(n))
    return np.concatenate(owner), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, rows: list[tuple[str, bool, bool]], ids: _Ids) -> np.ndarray:
        owner, feature = features(rows, ids)
        total = np.bincount(owner, self.weights[feature], len(rows)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(rows: list[tuple[str, bool, bool]], labels: list[bool], steps: int = STEPS, ridge: float = RIDGE, share: np.ndarray | float = 1.0) -> Linear:
    """Logistic regression with an L2 penalty, the labels together weighted 3 to 7, by Adam on the whole sample. ``share``
    says how the rows of a label divide its weight."""
    owner, feature = features(rows, _Ids())
    used, column = np.unique(feature, return_inverse=True)
    y = np.array(labels, float)
    yes, no = y * share, (1 - y) * share
    weight = 0.3 * yes / max(1e-9, yes.sum()) + 0.7 * no / max(1e-9, no.sum())
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column], len(y)) + b, -40, 40)))
        error = weight * (p - y)
        g = np.bincount(column, error[owner], len(w)) + ridge * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        gb = error.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Linear(weights, float(b))


def stripped(rows: list[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    """Labelled sentences without their placeholders, where five words or more are left: these are content."""
    out = [(_FIELD.sub(" ", s), first, only) for s, first, only in rows if _FIELD.search(s)]
    return [r for r in out if len(r[0].split()) >= 5 and not weak_label(r[0])]


def fit_cleaned(positive: list, other: list) -> Linear:
    """Fit on labelled and unlabelled rows without those unlabelled ones that a fit on the other half doubts."""
    ids, kept, content = _Ids(), [], stripped(positive)
    labels = [sort_of(s)[1] for s, _, _ in positive]
    count = Counter(labels)
    even = np.array([EVEN / max(EVEN, count[name]) for name in labels])
    share = lambda rest: np.concatenate([even, np.ones(len(rest))])
    for own, rest in ((other[::2], other[1::2]), (other[1::2], other[::2])):
        rest = rest + content
        model = fit(positive + rest, [True] * len(positive) + [False] * len(rest), STEPS // 2, share=share(rest))
        kept += [r for r, p in zip(own, model.score(own, ids) if own else ()) if p < DOUBT]
    kept += content
    return fit(positive + kept, [True] * len(positive) + [False] * len(kept), share=share(kept))


def _level(counts: list[int], size: int) -> int:
    """The least level at which ``counts``, none taken above it, reach ``size``; the greatest count if they do not."""
    low, high = 1, max(counts, default=1)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if sum(min(c, mid) for c in counts) >= size else (mid + 1, high)
    return low


def _labelled(sizes: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct segments of a task with their kinds and labels: of each kind those of least hash, as many of each label
        as reach the kind's size together. What a task leaves out is not in the sample of all texts either: a label has no
        more segments in a task than in all, so the level of a task is not below that of all."""
        held: list[dict[str, dict[int, tuple]]] = [{}, {}, {}]
        limit: dict[tuple[int, str], int] = {}
        count = [0, 0, 0]

        def thin(kind: int) -> None:
            level = _level([len(rows) for rows in held[kind].values()], sizes[kind])
            for name, rows in held[kind].items():
                if len(rows) > level:
                    held[kind][name] = {h: rows[h] for h in sorted(rows)[:level]}
                    limit[kind, name] = max(held[kind][name])
            count[kind] = sum(map(len, held[kind].values()))

        for batch in batches:
            for text in batch.column("text").to_pylist():
                parts = segments(text)
                for k, s in enumerate(parts):
                    kind, name = sort_of(s)
                    h = xxhash.xxh3_64_intdigest(s)
                    if h > limit.get((kind, name), h):
                        continue
                    rows = held[kind].setdefault(name, {})
                    row = k == 0, len(parts) == 1, s
                    if h in rows:
                        # The place of a repeated segment is not left to the order of the texts.
                        rows[h] = max(rows[h], row)
                        continue
                    rows[h] = row
                    count[kind] += 1
                    if count[kind] > 2 * sizes[kind] + len(held[kind]):
                        thin(kind)
        for kind in (0, 1, 2):
            thin(kind)
            rows = [(h - (1 << 63), *row, name) for name, part in held[kind].items() for h, row in part.items()]
            for at in range(0, len(rows), 2000):
                h, first, only, s, name = zip(*rows[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.string()), pa.array(first), pa.array(only), pa.array([kind] * len(h), pa.int32()), pa.array(name, pa.string())], ["hash", "segment", "first", "only", "kind", "label"])

    return run


def training_sample(documents: DataFrame, size: int = SAMPLE, labelled: int = LABELLED) -> dict[int, list]:
    """At most ``size`` distinct segments of each unlabelled kind and ``labelled`` labelled ones from one pass over all
    texts: those whose hash is least, of labelled ones as many of each label as there is room for, so that a label of few
    segments stays beside one of very many. The sample follows from the set of segments alone, not from the number of
    texts or of their copies."""
    sizes = [size, size, labelled]
    rows = documents.select("text").mapInArrow(_labelled(sizes), "hash long, segment string, first boolean, only boolean, kind int, label string")
    rows = materialize(rows, "residue-sample")
    out = {}
    for kind in (0, 1, 2):
        found = rows.where(F.col("kind") == kind).groupBy("label", "hash").agg(F.max(F.struct("first", "only", "segment")).alias("row"))
        if kind == 2:
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("hash"))).where(F.col("rank") <= labelled)
        found = found.orderBy(*(("rank", "hash") if kind == 2 else ("hash",))).limit(sizes[kind]).select("hash", "row.*").collect()
        out[kind] = [(r["segment"], r["first"], r["only"]) for r in sorted(found, key=lambda r: r["hash"])]
    return out


def train(documents: DataFrame) -> Linear | None:
    rows = training_sample(documents)
    return fit_cleaned(rows[2], rows[0] + rows[1]) if rows[2] and rows[0] + rows[1] else None


def _scored(texts: pa.Array, model: Linear, ids: _Ids) -> tuple[list, np.ndarray, np.ndarray]:
    """(segments, the text each belongs to, their scores) of some texts."""
    rows, owner = [], []
    for d, text in enumerate(texts.to_pylist()):
        parts = segments(text)
        rows += [(s, k == 0, len(parts) == 1) for k, s in enumerate(parts)]
        owner += [d] * len(parts)
    return rows, np.array(owner, np.int64), model.score(rows, ids) if rows else np.zeros(0)


def _score(held, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, model = _Ids(), held.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                _, owner, p = _scored(part.column("text"), model, ids)
                best = np.zeros(part.num_rows)
                np.maximum.at(best, owner, p)
                hit = np.flatnonzero(best >= threshold)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(hit)), pa.array(np.round(best[hit], 6))], ["doc_id", "score"])

    return run


def residue(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score): texts with a segment that the classifier takes for residue, and the score of the surest one."""
    model = train(documents)
    if model is None:
        return documents.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    held = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select("doc_id", "text").mapInArrow(_score(held, threshold), "doc_id long, score double")


def _judge(held, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, model = _Ids(), held.value
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                sources = part.column("source").to_pylist()
                rows, owner, p = _scored(part.column("text"), model, ids)
                for d, (s, *_), score in zip(owner.tolist(), rows, p):
                    label, said = weak_label(s), score >= threshold
                    counts.setdefault(sources[d], np.zeros(4, np.int64))[:] += (1, label, said, label and said)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c) for c in np.array(list(counts.values())).T)], ["source", "n", "labelled", "told", "both"])

    return run


def validation(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Agreement with the weak labels on sources held out of training (every third by name): segments, labelled ones,
    precision and recall per source. Only training rows are a sample, of the other sources; every segment of every text of
    the held-out sources is judged, by the rule of ``residue``. Of sources no more than counts leave a task."""
    shape = "source string, segments long, labelled long, precision double, recall double"
    spark = documents.sparkSession
    named = documents.select("text", F.coalesce("source", F.lit("")).alias("source"))
    # Places come from a sort of the distinct names, which may be many; they are not collected.
    names = ordinals(named.select("source").distinct(), "source").select("source", (F.col("ordinal") % 3 == 0).alias("out"))
    names = materialize(names, "sources")
    pick = lambda out: keep_keys(named, names.where("out" if out else "not out").select("source"), "source")
    model = train(pick(False))
    if model is None:
        return spark.createDataFrame([], shape)
    held = spark.sparkContext.broadcast(model)
    counts = pick(True).mapInArrow(_judge(held, threshold), "source string, n long, labelled long, told long, both long")
    total = counts.groupBy("source").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "told", "both")))
    share = lambda of: F.round(F.try_divide("both", of), 4)
    return total.select("source", F.col("n").alias("segments"), "labelled", share("told").alias("precision"), share("labelled").alias("recall"))
