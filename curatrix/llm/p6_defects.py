"""Problem 6: question-answer pairs whose answer is defective.

A linear-chain conditional random field tags every clause of an answer as answer, refusal, echo (of the question),
foreign (another language than the question's) or unfinished. Clause tags are aggregated to the pair: a defect holds if
its clauses cover enough of the answer, or for a truncated answer if its last clause is unfinished. An answer without
any clause is empty.

The field is trained here on weak labels from a bounded sample (``SAMPLE`` pairs, chosen by hash): the other options of
a record are complete clauses in its language; cut short they are unfinished; put beside a question of another record
in another language they are foreign, as are made-up ones (function words of another language between content words, or
letters of another script); pieces of the question are echoes; refusals are composed from general wording, with words of
other answers as what is refused. The field's tags alone decide; of the kinds only ``empty`` is a rule. Every pair is
tagged; nothing is shuffled but the sample.

The answer is the option its letter names (``B``, ``(b)``, ``B.``, ``Option B``, ``Answer: B``), the text after a letter,
or the text itself.

Cases: a null generated_vqa has no row; a null, blank or invisible answer, a stand-in for nothing (``n/a``, ``--``,
``null``) and a letter whose option is missing are ``empty``; a null question has no language and no echo; each row has
one defect at most, the first of empty, refusal, copied_question, other_language, truncated; repeated rows have a row
each; very long answers are tagged clause by clause; an empty table gives an empty result. Extra columns are ignored;
needed are mcq_id and generated_vqa.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Pairs the field is trained on, hashed features, steps and strength of regularisation.
SAMPLE, BITS, STEPS, RIDGE = 2_000, 18, 90, 1e-5
#: A feature of fewer clauses than this in the sample is left out.
SEEN = 3
#: Share of an answer's characters that clauses of a tag must cover.
COVER = 0.5
#: The same for refusals, which may carry reasons and advice.
REFUSED = 0.3

# Function words by language.
_FUNCTION = {
    "en": "the a an of and in on with without to from for is are was by at this that no not but it its after before between which what there into around near because be has have had cannot i my me you your we our they their he she can could will would may must should do does if so than then when who how all any each other some such only under over during about as or these those",
    "fr": "le la les un une des du de et en dans avec sans pour est sont sur par au aux ce cette ces que qui mais ne pas il elle son sa ses depuis près quelle quel chez aucune aucun entre d l",
    "de": "der die das den dem des ein eine einer eines einem einen und in im mit ohne für ist sind auf von zu zum zur an am bei nach nicht kein keine aber es sich wird neben seit zwischen welche was über",
    "es": "el la los las un una unos unas de del y en con sin para es son sobre por al este esta que pero no se su hay desde cerca ninguna ningún entre qué cuál ve lo",
    "it": "il lo la i gli le un uno una di del della dello dei e in nel nella con senza per è sono su da al alla questo questa che ma non si vede nessuna nessun tra vicino altre",
    "pt": "o a os as um uma de do da dos das e em no na com sem para é são sobre por ao à este esta que mas não se há nenhuma nenhum entre perto outra desde",
    "nl": "de het een van en in op met zonder voor is zijn door bij aan dit dat niet geen maar er na tussen welke wat naast sinds",
    "pl": "i w na z bez dla jest są od do przy ten ta to nie ale się po między która co obok brak oraz",
    "sv": "en ett den det och i på med utan för är av till vid detta inte men efter mellan vilken vad ingen sedan nära",
}
FUNCTION = {lang: frozenset(ws.split()) for lang, ws in _FUNCTION.items()}
_SHARED = {w: sum(w in ws for ws in FUNCTION.values()) for ws in FUNCTION.values() for w in ws}
# Words by which a text speaks of its writer or to its reader.
_PERSON = frozenset("i me my myself we us our you your ich mir mich mein wir uns sie ihnen je j me moi mon nous vous yo mí mi nos usted usteds io noi eu nós ik mij ja jag".split()) - frozenset(("sie",))
# Texts that stand for no answer.
NOTHING = frozenset("null none nil nan na n/a not available not applicable no answer no response no reply answer empty blank missing undefined".split()) - frozenset("not no available applicable response reply".split())
NOTHING_PHRASES = frozenset(("no answer", "not available", "not applicable", "no response", "no reply", "n a", "not given", "none given", "sin respuesta", "keine antwort", "pas de réponse"))
# General wording of refusals (opening, verb, object, ending), from common usage.
_REFUSE = {
    "en": (
        ("", "", "Sorry, but ", "Sorry. ", "I am sorry, ", "I'm sorry, but ", "Unfortunately, ", "I regret that ", "As an AI language model, ", "As an assistant, ", "Apologies, but ", "My apologies. ", "I apologize, but "),
        ("I can't ", "I cannot ", "I could not ", "I am unable to ", "I'm unable to ", "I'm not able to ", "I am not able to ", "I won't ", "I will not ", "I must decline to ", "I have to decline to ", "I refuse to ", "I'd rather not ", "I'm not allowed to ", "it is not possible for me to ", "it would be wrong for me to "),
        ("help with that", "help you here", "assist with this", "answer that", "answer this question", "give an answer", "respond to this", "make a diagnosis", "diagnose anyone", "offer medical advice", "judge this image", "look at pictures", "see the picture", "say which option is right", "pick one of the options", "discuss this person", "share that information"),
        ("", "", "", " at the moment", " without further information", " because of my policy", "; please see a doctor", ", please ask a professional", " as no image was attached"),
    ),
    "de": (("", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, "), ("ich kann ", "kann ich ", "ich darf ", "darf ich "), ("diese Frage nicht beantworten", "dazu nichts sagen", "Ihnen dabei nicht helfen", "das Bild nicht beurteilen", "keine Diagnose stellen", "keinen Rat geben"), ("", " ohne weitere Angaben", "; fragen Sie bitte einen Arzt")),
    "fr": (("", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, "), ("je ne peux pas ", "je ne suis pas en mesure de ", "il m'est impossible de ", "je refuse de "), ("répondre à cela", "répondre à la question", "vous aider", "juger cette image", "poser un diagnostic", "donner un avis médical"), ("", " sans autre information", "; consultez un professionnel")),
    "es": (("", "Lo siento, ", "Lo siento, pero ", "Por desgracia, ", "Lamentablemente, "), ("no puedo ", "no me es posible ", "me niego a "), ("responder a eso", "responder a la pregunta", "ayudarle con esto", "valorar la imagen", "dar un diagnóstico", "dar consejos médicos"), ("", " sin más datos", "; consulte a un profesional")),
    "it": (("", "Mi dispiace, ", "Purtroppo "), ("non posso ", "non sono in grado di "), ("rispondere alla domanda", "aiutare", "valutare l'immagine"), ("", " senza altri dati")),
    "pt": (("", "Desculpe, ", "Infelizmente "), ("não posso ", "não consigo "), ("responder à pergunta", "ajudar", "avaliar a imagem"), ("", " sem mais dados")),
}

_LETTER = re.compile(r"^\W*(?:the\s)?(?:(?:correct\s)?(?:answer|option|choice)(?:\sis)?\s*[:.]?\s*)?[(\[]?([A-F])[)\].:]?\W*$", re.I)
_LETTERED = re.compile(r"^\s*(?:(?:[Aa]nswer|[Oo]ption)\s*:?\s*)?[(\[]?([A-F])[)\].:]\s+(?=\S)")
_CLAUSE = re.compile(r"(?<=[.;:!?。；！？])\s+|(?<=,)\s+|\s+[-–—]\s+")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def cleaned(text: str) -> str:
    return " ".join(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).split())


def answer_text(vqa: dict | None) -> str | None:
    """The answer of a pair: an option's text, or the text given."""
    if vqa is None or vqa.get("answer") is None:
        return None
    text = cleaned(vqa["answer"])
    letter = _LETTER.match(text)
    if letter:
        return (vqa.get("options") or {}).get(letter[1].upper())
    return _LETTERED.sub("", text)


def is_nothing(text: str | None) -> bool:
    """Null, without letters and digits, or a stand-in for nothing."""
    if text is None:
        return True
    plain = " ".join(_WORD.findall(cleaned(text).lower()))
    return not plain or plain in NOTHING or plain in NOTHING_PHRASES


_SCRIPTS = (("CJK", "zh"), ("HIRAGANA", "ja"), ("KATAKANA", "ja"), ("HANGUL", "ko"), ("CYRILLIC", "ru"), ("ARABIC", "ar"), ("GREEK", "el"), ("HEBREW", "he"), ("DEVANAGARI", "hi"), ("THAI", "th"))


def languages(text: str) -> dict[str, float]:
    """Evidence for languages: function words, each shared among the languages that have it, or the script."""
    out: dict[str, float] = {}
    if not text.isascii():
        letters = [c for c in text if c.isalpha() and ord(c) > 0x24F]
        if 2 * len(letters) > sum(c.isalpha() for c in text):
            for c in letters:
                name = unicodedata.name(c, "")
                for start, lang in _SCRIPTS:
                    if name.startswith(start):
                        out[lang] = out.get(lang, 0) + 1
                        break
                else:
                    out["xx"] = out.get("xx", 0) + 1
            return out
    for w in _WORD.findall(text.lower()):
        if w in _SHARED:
            for lang, ws in FUNCTION.items():
                if w in ws:
                    out[lang] = out.get(lang, 0.0) + 1 / _SHARED[w]
    return out


def language(text: str | None) -> str:
    found = languages(text or "")
    return max(sorted(found), key=found.get) if found else ""


def _echoed(words: list[str], question: list[str], run: int = 4) -> list[bool]:
    """Which words of an answer lie in a run of ``run`` or more words that also stands in the question."""
    n = min(run, len(words))
    known = {tuple(question[i : i + n]) for i in range(len(question) - n + 1)}
    out = [False] * len(words)
    if n < 2:
        return out
    for i in range(len(words) - n + 1):
        if tuple(words[i : i + n]) in known:
            out[i : i + n] = [True] * n
    return out


def clauses(text: str) -> list[str]:
    return [c for c in _CLAUSE.split(cleaned(text)) if c.strip()]


def _stop(text: str) -> str:
    text = text.rstrip(" \"'”’»)]")
    return text[-1] if text and not text[-1].isalnum() else ""


@dataclass
class Pair:
    question: str | None
    answer: str
    siblings: list[str]


def _known(w: str, vocabulary: frozenset) -> str:
    return "0" if w.isdigit() else w if w in vocabulary else "_"


def strangeness(pair: Pair) -> float:
    """Evidence that the answer is in another language less evidence for the question's; 0 if that is unknown."""
    tongue = language(pair.question)
    found = languages(pair.answer)
    return max((v for k, v in found.items() if k != tongue), default=0.0) - found.get(tongue, 0.0) if tongue else 0.0


def pair_features(pair: Pair, vocabulary: frozenset, endings: frozenset) -> list[list[str]]:
    """Features of every clause of a pair's answer; ``endings`` are those of last words of complete texts."""
    parts = clauses(pair.answer)
    asked = _WORD.findall(cleaned(pair.question or "").lower())
    tongue = language(pair.question)
    words = [_WORD.findall(c.lower()) for c in parts]
    flat = [w for ws in words for w in ws]
    echo, at = _echoed(flat, asked), 0
    share = sum(echo) / max(1, len(echo))
    whole = languages(" ".join(parts))
    others = max((v for k, v in whole.items() if k != tongue), default=0.0)
    margin = max(-3, min(3, round(others - whole.get(tongue, 0.0)))) if tongue else 0
    siblings = [s for s in pair.siblings if s]
    stops = [_stop(cleaned(s)) for s in siblings]
    usual = max(sorted(set(stops)), key=stops.count) if stops else "?"
    agreed = stops.count(usual) * 2 > len(stops)
    sibling_words = sorted(len(_WORD.findall(s)) for s in siblings)
    middle = sibling_words[len(sibling_words) // 2] if sibling_words else 0
    brief = "unknown" if not middle else "short" if len(flat) < 0.55 * middle else "usual"
    out = []
    for k, (clause, ws) in enumerate(zip(parts, words)):
        last = k == len(parts) - 1
        own, at = echo[at : at + len(ws)], at + len(ws)
        names = [_known(w, vocabulary) for w in ws]
        f = ["bias", f"place:{'only' if len(parts) == 1 else 'last' if last else 'first' if not k else 'inner'}"]
        f += [f"w:{n}" for n in names] + [f"ww:{a} {b}" for a, b in zip(names, names[1:])]
        f += [f"echo:{int(4 * sum(own) / max(1, len(own)))}", f"echoes:{int(5 * share)}", f"echoes:{int(5 * share)}:{min(4, len(flat) // 4)}"]
        f += [f"tongue:{margin}", f"same:{bool(tongue) and whole.get(tongue, 0) > 0.3 * others}:{margin > 0}"]
        found = languages(clause)
        f += [f"clause:{bool(found) and tongue not in found}", f"person:{not _PERSON.isdisjoint(ws)}"]
        if last:
            stop = _stop(clause)
            tail = clause.rstrip()[-1:]
            f += [f"stop:{stop or 'none'}", f"tail:{tail if not tail.isalnum() else 'a'}", f"brief:{brief}", f"stops:{agreed and usual == '.'}:{stop or 'none'}"]
            f.append(f"open:{clause.count('(') > clause.count(')') or clause.count('[') > clause.count(']')}")
            if names:
                end, before = names[-1], names[-2] if len(names) > 1 else "^"
                f += [f"end:{end}", f"ends:{before} {end}", f"ending:{ws[-1][-3:]}:{end == '_'}", f"endlen:{min(len(ws[-1]), 12)}:{end == '_'}"]
                f += [f"good:{ws[-1][-4:] in endings}:{end == '_'}", f"ending2:{ws[-1][-2:]}:{end == '_'}", f"ending4:{ws[-1][-4:]}:{end == '_'}"]
                f += [f"ends3:{' '.join(names[-3:])}"]
                kinds = ["_" if n == "_" else n for n in names]
                f += [f"has:{n}>{end}" for n in set(kinds[:-1])] + [f"opens:{' '.join(names[:2])}>{end}", f"opens:{' '.join(names[:2])}:{min(len(names), 20)}"]
        out.append(f)
    return out


class _Ids(dict):
    def __missing__(self, name: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[name] = xxhash.xxh3_64_intdigest(name) >> (64 - BITS)
        return value


def _encode(sequences: list[list[list[str]]], ids: _Ids):
    """(feature, its clause, clause's sequence, clause's place, lengths)."""
    feature, owner, seq, place = [], [], [], []
    lengths = np.array([len(s) for s in sequences])
    c = 0
    for k, s in enumerate(sequences):
        for j, names in enumerate(s):
            feature += [ids[n] for n in names]
            owner += [c] * len(names)
            seq.append(k)
            place.append(j)
            c += 1
    return np.array(feature, np.int64), np.array(owner, np.int64), np.array(seq, np.int64), np.array(place, np.int64), lengths


@dataclass
class Field:
    """Weights of a linear-chain conditional random field: emissions by feature, and transitions between tags."""

    emission: np.ndarray
    transition: np.ndarray
    vocabulary: frozenset
    endings: frozenset

    def _scores(self, feature, owner, n):
        return np.stack([np.bincount(owner, self.emission[feature, t], n) for t in range(len(TAGS))], 1)

    def marginals(self, encoded) -> np.ndarray:
        feature, owner, seq, place, lengths = encoded
        return _marginals(self._scores(feature, owner, len(seq)), self.transition, seq, place, lengths)[0]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _marginals(scores, transition, seq, place, lengths):
    """(clause tag probabilities, expected transition counts by weight 1 a sequence pair) by forward and backward sums."""
    n, steps, tags = len(lengths), int(lengths.max()) if len(lengths) else 0, len(TAGS)
    grid = np.zeros((n, steps, tags))
    grid[seq, place] = scores
    # Most answers are one clause, so each step works on the sequences that reach it.
    live = [np.flatnonzero(lengths > t) for t in range(steps)]
    ahead, behind = np.zeros_like(grid), np.zeros_like(grid)
    for t, rows in enumerate(live):
        ahead[rows, t] = grid[rows, t] if t == 0 else grid[rows, t] + _logsum(ahead[rows, t - 1, :, None] + transition[None], 1)
    for t in range(steps - 2, -1, -1):
        rows = live[t + 1]
        behind[rows, t] = _logsum(transition[None] + (grid[rows, t + 1] + behind[rows, t + 1])[:, None, :], 2)
    total = _logsum(ahead[np.arange(n), np.maximum(lengths - 1, 0)], 1) if n else np.zeros(0)
    p = np.exp(ahead + behind - total[:, None, None])
    moves = np.zeros((tags, tags))
    for t in range(steps - 1):
        rows = live[t + 1]
        joint = ahead[rows, t, :, None] + transition[None] + (grid[rows, t + 1] + behind[rows, t + 1])[:, None, :]
        moves += np.exp(joint - total[rows, None, None]).sum(0)
    return p[seq, place], moves


def fit(sequences: list[list[list[str]]], gold: list[list[int]], vocabulary: frozenset, endings: frozenset, steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over the whole sample."""
    feature, owner, seq, place, lengths = _encode(sequences, _Ids())
    tags = len(TAGS)
    truth = np.array([t for g in gold for t in g])
    one = np.eye(tags)[truth]
    moved = np.zeros((tags, tags))
    for g in gold:
        for a, b in zip(g, g[1:]):
            moved[a, b] += 1
    often = np.bincount(feature, minlength=1 << BITS) >= SEEN
    feature, owner = feature[often[feature]], owner[often[feature]]
    used, at = np.unique(feature, return_inverse=True)
    w, trans = np.zeros((len(used), tags), np.float32), np.zeros((tags, tags))
    m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    n = len(lengths)
    # Features come clause by clause, and every clause has one that is kept (its bias).
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    by = np.argsort(at, kind="stable")
    clause_of, first = owner[by], np.searchsorted(at[by], np.arange(len(used)))
    for t in range(1, steps + 1):
        scores = np.add.reduceat(w[at], starts, axis=0).astype(float)
        p, moves = _marginals(scores, trans, seq, place, lengths)
        error = ((p - one) / n).astype(np.float32)
        g = np.add.reduceat(error[clause_of], first, axis=0) + np.float32(ridge) * w
        gt = (moves - moved) / n + ridge * trans
        for x, grad, mean, square in ((w, g, m, v), (trans, gt, mt, vt)):
            mean *= 0.9
            mean += 0.1 * grad
            square *= 0.99
            square += 0.01 * grad * grad
            x -= 0.15 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    emission = np.zeros((1 << BITS, tags), np.float32)
    emission[used] = w
    return Field(emission, trans, vocabulary, endings)


# First and last letter of scripts that made-up foreign words are drawn from.
_LETTERS = (("一", "鿋"), ("а", "я"), ("ぁ", "ん"), ("가", "힣"), ("ء", "ي"), ("α", "ω"), ("א", "ת"), ("अ", "ह"))


def _made_foreign(tongue: str, content: list[str], rng: random.Random) -> str:
    """Words that are not in ``tongue``: function words of another language between content words, or letters of another script."""
    n = rng.randint(4, 12)
    if rng.random() < 0.4:
        first, last = map(ord, rng.choice(_LETTERS))
        made = ["".join(chr(rng.randint(first, last)) for _ in range(rng.randint(2, 9))) for _ in range(n)]
        return rng.choice((" ", " ", "")).join(made) + rng.choice(("", "", ".", "。"))
    words = sorted(FUNCTION[rng.choice(sorted(set(FUNCTION) - {tongue}))])
    made = [rng.choice(words) if rng.random() < 0.55 else rng.choice(content) + rng.choice(("", "", "o", "a", "e", "ar", "en")) for _ in range(n)]
    if n > 6 and rng.random() < 0.4:
        made[n // 2] += ","
    return " ".join(made) + rng.choice(("", "."))


def _options(vqa: dict) -> list[str]:
    return [cleaned(t) for t in (vqa.get("options") or {}).values() if t and not is_nothing(t)]


def _cut(text: str, rng: random.Random) -> str:
    """A text broken off at a word or within one, sometimes with a trailing mark."""
    words = text.rstrip(".").split()
    k = rng.choice((rng.randint(min(2, len(words) - 1), len(words) - 1), len(words) - 1, rng.randint(min(2, len(words) - 1), len(words) - 1)))
    kept = words[:k]
    if rng.random() < 0.45 and len(words[k]) > 4:
        kept.append(words[k][: rng.randint(2, len(words[k]) - 2)])
    body = " ".join(kept)
    tail = rng.choice(("", "", "", "", "", "", ",", "-", "…", "...", " (approximately 4", " [panel", " (see", " [see", " (cf", " and the", " the", ";", " ("))
    return body + tail


def examples(sample: list[dict], seed: int = 5) -> tuple[list[Pair], list[list[int]]]:
    """Weakly labelled pairs from a sample of generated_vqa values."""
    rng = random.Random(seed)
    pairs, gold = [], []
    by_language: dict[str, list[str]] = {}
    sample_texts = [text for vqa in sample for text in _options(vqa)]
    for vqa in sample:
        for text in _options(vqa)[:2]:
            by_language.setdefault(language(vqa.get("question")), []).append(text)

    def add(question, text, siblings, tag, only_last=False):
        parts = clauses(text)
        if parts:
            pairs.append(Pair(question, text, siblings))
            gold.append([0] * (len(parts) - 1) + [tag] if only_last else [tag] * len(parts))

    for vqa in sample:
        question, options = vqa.get("question"), _options(vqa)
        answer = answer_text(vqa)
        asked = _WORD.findall(cleaned(question or "").lower())
        tongue = language(question)
        whole = []
        for text in options:
            if text == cleaned(answer or ""):
                continue
            ws = _WORD.findall(text.lower())
            stops = [_stop(o) for o in options]
            odd = (stops.count(".") * 2 > len(stops)) != (_stop(text) == ".")
            tails = text[-1] in ",-…(;:"
            if not odd and not tails and sum(_echoed(ws, asked)) * 2 < len(ws) and language(text) in (tongue, ""):
                whole.append(text)
        for text in whole[:3]:
            siblings = [o for o in options if o != text]
            add(question, text, siblings, 0)
            if len(text.split()) > 3:
                add(question, _cut(text, rng), siblings, 4, only_last=True)
        if not whole:
            continue
        siblings = whole[1:]
        if rng.random() < 0.4:
            style = _REFUSE[tongue if tongue in _REFUSE and rng.random() < 0.7 else rng.choice(list(_REFUSE) + ["en"] * 4)]
            opening, verb, thing, ending = (rng.choice(part) for part in style)
            # What is refused, and what follows, may be anything: words of other answers stand for it in half of the cases.
            loose = [w for o in rng.choice(sample_texts).split() for w in (o.strip(".,;:()"),) if w]
            if rng.random() < 0.5:
                thing = " ".join(rng.sample(loose, min(len(loose), rng.randint(1, 5))))
            if rng.random() < 0.3:
                ending = " " + " ".join(rng.sample(loose, min(len(loose), rng.randint(1, 4))))
            add(question, opening + verb + thing + ending + rng.choice(("", ".")), siblings, 1)
        if rng.random() < 0.5 and question:
            ws = cleaned(question).split()
            n = rng.randint(max(4, len(ws) // 2), len(ws)) if len(ws) > 4 else len(ws)
            start = rng.choice((0, 0, len(ws) - n))
            text = " ".join(ws[start : start + n])
            text = rng.choice((text, text.lower(), text.upper(), f"“{text}”", text.rstrip("?"), text.lower().rstrip("?")))
            add(question, text, siblings, 2)
        elsewhere = [k for k in by_language if k != tongue and k]
        if elsewhere and tongue and rng.random() < 0.5:
            text = rng.choice(by_language[rng.choice(elsewhere)])
            if strangeness(Pair(question, text, [])) > 0:
                add(question, text, siblings, 3)
        content = [w for w in _WORD.findall(" ".join(whole)) if w.lower() not in _SHARED]
        if tongue and content and rng.random() < 0.4:
            text = _made_foreign(tongue, content, rng)
            if strangeness(Pair(question, text, [])) > 0:
                add(question, text, siblings, 3)
    return pairs, gold


def train(pairs_table: DataFrame, size: int = SAMPLE) -> Field | None:
    """Fit on at most ``size`` pairs, those whose hash of the question is least (distinct questions)."""
    rows = pairs_table.where("generated_vqa is not null").select("generated_vqa", F.xxhash64("generated_vqa.question", "generated_vqa.options").alias("h"))
    total = rows.count()
    if total > 20 * size:
        rows = rows.where(F.pmod("h", F.lit(1 << 20)) < (1 << 20) * 8 * size // total)
    chosen = rows.dropDuplicates(["h"]).orderBy("h").limit(size).collect()
    sample = [r["generated_vqa"].asDict(recursive=True) for r in chosen]
    pairs, gold = examples(sample)
    if not pairs:
        return None
    return fit_examples(pairs, gold)


def fit_examples(pairs: list[Pair], gold: list[list[int]]) -> Field:
    seen: dict[str, int] = {}
    last: dict[str, int] = {}
    for p, g in zip(pairs, gold):
        ws = _WORD.findall(p.answer.lower())
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
        if ws and g[-1] == 0:
            last[ws[-1][-4:]] = last.get(ws[-1][-4:], 0) + 1
    vocabulary = frozenset(w for w, n in seen.items() if n >= max(5, len(pairs) // 1500))
    endings = frozenset(e for e, n in last.items() if n >= max(2, len(pairs) // 4000))
    return fit([pair_features(p, vocabulary, endings) for p in pairs], gold, vocabulary, endings)


def defect(pair: Pair, p: np.ndarray, cover: float = COVER) -> str | None:
    """The defect of a pair from the tag probabilities of its clauses: the tag that covers enough of the answer, by its
    characters, or ``truncated`` where the last clause is unfinished."""
    tags, size = p.argmax(1), np.array([len(c) for c in clauses(pair.answer)], float)
    share = np.bincount(tags, size, len(TAGS)) / size.sum()
    for tag, kind, least in ((1, "refusal", REFUSED), (2, "copied_question", cover), (3, "other_language", cover)):
        if share[tag] >= least:
            return kind
    return "truncated" if tags[-1] == 4 else None


def _tag(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, ids = held.value, _Ids()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out, waiting = [], []
                for key, vqa in zip(part.column("mcq_id").to_pylist(), part.column("generated_vqa").to_pylist()):
                    text = answer_text(vqa)
                    if is_nothing(text):
                        out.append((key, "empty"))
                    elif field is not None:
                        letter = _LETTER.match(cleaned(vqa["answer"]))
                        named = letter[1].upper() if letter else ""
                        siblings = [t for k, t in (vqa.get("options") or {}).items() if k != named and t and cleaned(t) != cleaned(text)]
                        waiting.append((key, Pair(vqa.get("question"), text, siblings)))
                if waiting:
                    sequences = [pair_features(pair, field.vocabulary, field.endings) for _, pair in waiting]
                    encoded = _encode(sequences, ids)
                    p = field.marginals(encoded)
                    ends = np.cumsum(encoded[4])
                    for (key, pair), end, n in zip(waiting, ends, encoded[4]):
                        if n:
                            kind = defect(pair, p[end - n : end])
                            if kind:
                                out.append((key, kind))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([d for _, d in out])], ["mcq_id", "defect"])

    return run


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(mcq_id, defect), one row per defective pair; without training rows only empty answers can be told."""
    held = pairs.sparkSession.sparkContext.broadcast(train(pairs))
    return pairs.where("generated_vqa is not null").select("mcq_id", "generated_vqa").mapInArrow(_tag(held), "mcq_id long, defect string")


def defect_counts(pairs: DataFrame) -> DataFrame:
    """Defective pairs per dataset_name and kind."""
    return defective_pairs(pairs).join(pairs.select("mcq_id", "dataset_name"), "mcq_id").groupBy("dataset_name", "defect").agg(F.count("*").alias("pairs"))
