"""Language of documents and of their segments.

``prose_sentences`` finds the sentences of prose in a text; code, tables, log lines, figures, paths, names and
trailers are masked, so offsets stay those of the text.

``fit`` trains a sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams by
follow-the-regularised-leader with elastic-net penalties: on the labelled samples; then twice on sentences of a
bounded sample of documents whose delivered label the model before confirms, the second time only of documents
in which it sees no further language, but with the sentences it is not sure of; and a temperature on pairs of neighbouring
words from sentences held out (whole sentences are told apart too well to say anything about confidence).
Document frequencies cover all documents. The model is a table of 2**BITS x languages, whatever the corpus.

``identify`` scores every sentence of every document in one pass without a shuffle. A sentence's score is the sum of
its words' scores, and words repeat, so a task keeps the scores of the words it has met.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
#: Languages (ISO 639-1) with the three-letter codes that mean the same; zxx is text without prose.
CODES = {
    "en": ["eng"], "de": ["deu", "ger"], "fr": ["fra", "fre"], "es": ["spa"], "pt": ["por"], "it": ["ita"],
    "nl": ["nld", "dut"], "sv": ["swe"], "da": ["dan"], "pl": ["pol"], "ru": ["rus"], "uk": ["ukr"], "tr": ["tur"],
    "ja": ["jpn"], "zh": ["zho", "chi"], "zxx": [],
}

_FENCE = re.compile(r"^\s*(?:```|~~~)")
_TRAILER = re.compile(r"^\s*[A-Z][A-Za-z]*(?:-[A-Za-z]+)+:\s|^\s*(?:Fixes|Closes|Refs|See|Cc):\s+\S+\s*$")
_CODE = re.compile(r"[={}]|;\s*$|\w\[\d|\w\(\w*\)?\s*[:;]|^\s*\"|\":|^\s*(?:\+{3}|-{3}|@@)\s|^\s*(?:import|from|def|class|return|func|fn|const|let|var|public|private|SELECT|INSERT)\s.*[(){};=:]\s*$|^\s*<[^>]+>\s*$|^\s*[$%]\s+\w|^\s*at\s+\S+\(")
_TABLE = re.compile(r"^\s*\||^\s*[-+=]{3,}\s*$")
_STAMP_SIGNS = frozenset("0123456789[")
_STAMP = re.compile(r"^\s*\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
_START = re.compile(r"^(\s*)(>[>\s]*)?((?:[-*+•]|\d{1,3}[.)]|\[[^\]\s]{0,8}\]|\[ \])\s+)*")
_MASK = re.compile(
    r"\x1b\[[0-9;]*[A-Za-z]|`[^`\n]*`|<\|[^|\n]*\|>|<[^>\s]+@[^>\s]+>|\b[a-z]+://[^\s<>\"']+|[\w.+-]+@[\w-]+\.[\w.]+|!?\[[^\]\n]*\]\([^)\n]*\)"
    r"|(?<![A-Za-z0-9_])[A-Za-z0-9_.~-]*/[A-Za-z0-9_./~-]*[A-Za-z0-9_](?::\d+)?|(?<![A-Za-z0-9])[A-Za-z0-9+/]{24,}={0,2}"
    r"|(?<![A-Za-z0-9])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{6,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Za-z]+(?:-[A-Za-z0-9]+)*-\d+(?:\.\d+)*(?:-[A-Za-z0-9]+)*"
    r"|(?<![A-Za-z0-9])[A-Za-z_]\w*\.(?:py|kt|rs|go|ts|js|sql|toml|md|swift|java|json|yaml|yml|c|h|cpp|txt|sh)\b|(?<![A-Za-z0-9])[A-Za-z]+_[A-Za-z0-9_]+|#?\d[\d.,:/-]*",
    re.ASCII,
)
#: A token without one of these characters holds nothing to mask; neither does a line hold code without one of those.
_SPECIAL = re.compile(r"[0-9/_@<\x1b]|\.[a-z]|[A-Za-z0-9+/]{24}")
_SPECIAL_TOKEN = re.compile(r"(?<![^ ])(?:[^ ]*?(?:[0-9/_@<\x1b]|\.[a-z])[^ ]*|[^ ]{24,})")
_CODE_SIGN = re.compile(r"[={};:\[(\"<@$%]")
#: Ends of sentences, laid out so that the search runs over one class of characters: stops before a blank, stops of
#: scripts without blanks, breaks.
_END = re.compile(r"[.!?…。！？\x01](?:(?<=[.!?…])[.!?…]*[\"'»”’)]*(?=[\s\x01]|$)|(?<=[。！？])[。！？]*[」』”）]*|(?<=\x01)\x01*)")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_BREAK = re.compile(r"\r\n?|[\x0b\x0c\x85  ]")


def normal_label(label: str | None) -> str | None:
    """The language a label names, in whatever spelling (case, region, three letters); None where it names none."""
    if not label:
        return None
    head = re.split(r"[-_]", label.strip().lower())[0]
    return next((code for code, more in CODES.items() if head == code or head in more), None)


def _words(text: str) -> Callable[[str], list[str]]:
    """Function that lists the words of a part of ``text``."""
    return _ASCII_WORD.findall if text.isascii() else _WORD.findall


def _blank(match: re.Match) -> str:
    return "\x02" * len(match[0])


#: Tokens with their masks, for numbers, paths and names repeat; emptied when it is full.
_masks: dict[str, str] = {}


def _mask_token(match: re.Match) -> str:
    token = match[0]
    masked = _masks.get(token)
    if masked is None:
        if len(_masks) > 100_000:
            _masks.clear()
        masked = _MASK.sub(_blank, token)
        if len(token) < 100:
            _masks[token] = masked
    return masked


def _mask(line: str) -> str:
    """The line with everything that is no prose replaced, character by character."""
    if "`" in line or "](" in line or "<|" in line:
        return _MASK.sub(_blank, line)
    if not _SPECIAL.search(line):
        return line
    return _SPECIAL_TOKEN.sub(_mask_token, line)


def _without_pipes(line: str) -> str | None:
    """The line with the pipes and blanks at its end as blanks; None where it has cells between pipes and is a table's."""
    kept = line.rstrip()
    if not kept.endswith("|"):
        return line
    while kept.endswith("|"):
        kept = kept.rstrip("|").rstrip()
    return None if "|" in _mask(kept) else kept.ljust(len(line))


def prose_sentences(text: str) -> list[tuple[int, int, list[str], int]]:
    """(start, end, words, prose characters) of every sentence of prose in ``text``.

    Lines of a paragraph are read on; blank lines, list items, quotes and lines without prose end a sentence. A piece
    without two words of two letters, one of them of three (or four characters of a script without spaces), is none.
    """
    text = _BREAK.sub(lambda m: " \n"[-len(m[0]) :], text)
    out: list[str] = []
    fenced = quoted = False
    for line in text.split("\n"):
        if ("```" in line or "~~~" in line) and _FENCE.match(line):
            fenced = not fenced
            out.append("\x01" * (len(line) + 1))
            continue
        bare = _without_pipes(line) if "|" in line else line
        if fenced or bare is None or not (held := bare.strip()) or (held[0] in "|-+=" and _TABLE.search(line)) or (held[0] in _STAMP_SIGNS and _STAMP.match(line)) or (":" in held and _TRAILER.match(bare)):
            out.append("\x01" * (len(line) + 1))
            continue
        masked = _mask(bare)
        lead = _START.match(masked).end()
        bare = masked[lead:]
        heading = bare.startswith("#")
        if ((_CODE_SIGN.search(bare) or bare.lstrip()[:1] in ("+", "-")) and _CODE.search(bare)) or (masked[:1] in "+-" and masked[1:2].isspace() and masked[2:3].isspace()) or (heading and len(_WORD.findall(bare)) < 3 and not _CJK.search(bare)):
            out.append("\x01" * (len(line) + 1))
            continue
        quote = ">" in masked[:lead]
        opens = bool(masked[:lead].strip()) and not (quote and quoted and masked[:lead].strip(" >\t") == "")
        if opens or heading or quote != quoted:
            out.append("\x01" * lead)
            if out[:-1] and not lead:
                out[-2] = out[-2][:-1] + "\x01"
        else:
            out.append(" " * lead)
        quoted = quote
        out.append(bare + ("\x01" if heading else " "))
    masked = "".join(out)
    split = _words(masked)
    found = []
    begin = 0
    for end in [*(m.end() for m in _END.finditer(masked)), len(masked)]:
        piece, at, begin = masked[begin:end].rstrip("\x01"), begin, end
        words = split(piece)
        sizes = list(map(len, words))
        longest, letters = max(sizes, default=0), sum(sizes)
        if (longest < 3 or letters - longest < len(words)) and (not words or len(_CJK.findall(piece)) < 4):
            continue  # the words beside the longest have a letter each, or there are none
        start = at + len(piece) - len(piece.lstrip())
        found.append((start, min(at + len(piece), len(text)), words, letters + len(words) - 1))
    return found


def grams(word: str) -> list[int]:
    """Hashes of the character n-grams of a word: 1 to 4 with its ends marked, 1 to 2 in scripts without spaces."""
    word = word.lower()
    if _CJK.search(word):
        pieces = [word[i : i + n] for n in (1, 2) for i in range(len(word) - n + 1)]
    else:
        marked = f" {word} "
        pieces = [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1) if marked[i : i + n] != " "]
        pieces.append(marked)
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in pieces]


@dataclass
class Model:
    """Weights (buckets x languages), inverse document frequencies and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    _words: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_words": {}, "_rows": None}

    def _number(self, word: str) -> int:
        """Row of a word's summed weights in the table of words met."""
        if self._rows is None:
            self._rows = np.zeros((1024, len(self.langs) + 1), dtype=np.float32)
        number = self._words[word] = len(self._words)
        if number == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        at = np.array(grams(word), dtype=np.int64)
        self._rows[number, :-1] = (self.weights[at] * self.idf[at, None]).sum(0)
        self._rows[number, -1] = len(at)
        return number

    def probabilities(self, sentences: list[list[str]]) -> np.ndarray:
        """Calibrated probability of each language for each sentence (its words, at least one)."""
        out = [np.zeros((0, len(self.langs)))]
        for first in range(0, len(sentences), 4096):
            part = sentences[first : first + 4096]
            if len(self._words) > 250_000:  # none of this part may be dropped while it is read
                self._words, self._rows = {}, None
            for w in {w for words in part for w in words}.difference(self._words):
                self._number(w)
            numbers = list(map(self._words.__getitem__, chain.from_iterable(part)))
            starts = np.cumsum([0, *map(len, part[:-1])])
            sums = np.add.reduceat(self._rows[np.array(numbers)], starts, axis=0).astype(np.float64)
            z = (sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1)) + self.bias) / self.temperature
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)


def _vector(words: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.unique(np.array([g for w in words for g in grams(w)], dtype=np.int64), return_counts=True)
    return at, tf * idf[at] / math.sqrt(max(tf.sum(), 1))


def train(rows: list[tuple[list[str], str]], langs: list[str], idf: np.ndarray, epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, batch: int = 32) -> Model:
    """Follow-the-regularised-leader (proximal) over ``rows`` (words, language) with both penalties.

    Gradients are summed over ``batch`` rows before a step; only the weights of buckets that occur in them are touched.
    """
    k = len(langs)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    vectors = [(*_vector(words, idf), langs.index(lang)) for words, lang in rows]
    draw = np.random.default_rng(7)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        order = draw.permutation(len(vectors))
        for first in range(0, len(order), batch):
            part = [vectors[i] for i in order[first : first + batch]]
            used, place = np.unique(np.concatenate([v[0] for v in part]), return_inverse=True)
            x = np.zeros((len(part), len(used)))
            x[np.repeat(np.arange(len(part)), [len(v[0]) for v in part]), place] = np.concatenate([v[1] for v in part])
            zs, ns = z[used], n[used]
            w, wb = weights(zs, ns), weights(zb, nb)
            p = x @ w + wb
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [v[2] for v in part]] -= 1.0
            g, gb = x.T @ p, p.sum(0)
            z[used] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[used] = ns + g * g
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * wb
            nb += gb * gb
    return Model(langs, idf, weights(z, n).astype(np.float32), weights(zb, nb))


def calibrate(model: Model, rows: list[tuple[list[str], str]]) -> float:
    """The temperature with the least log loss on ``rows``, by golden section between 0.05 and 20."""
    model.temperature = 1.0
    logits = np.log(np.maximum(model.probabilities([words for words, _ in rows]), 1e-30))
    truth = np.array([model.langs.index(lang) for _, lang in rows])

    def loss(log_t: float) -> float:
        scaled = logits / math.exp(log_t)
        scaled = scaled - scaled.max(1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(1)) - scaled[np.arange(len(truth)), truth]).mean())

    low, high = math.log(0.05), math.log(20)
    for _ in range(40):
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each n-gram bucket occurs, over all words of all documents, and the number of documents.

    A task sends at most 2**BITS rows, and as many come to the driver.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << BITS, dtype=np.int64), 0
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                words = set(_words(value)(value)) if value else ()
                if not words:
                    continue
                total += 1
                if len(held) > 200_000:
                    held.clear()
                for w in words.difference(held):
                    held[w] = np.array(grams(w), dtype=np.int64)
                seen[np.concatenate([held[w] for w in words])] += 1  # a bucket that is listed twice is raised once
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([total, *seen[at].tolist()], pa.int64())], ["g", "n"])

    rows = docs.select(text).mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << BITS)
    total = 0
    for g, n in rows:
        if g < 0:
            total = int(n)
        else:
            df[g] = n
    return df, total


def fit(docs: DataFrame, samples: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", max_documents: int = 4000, max_sentences: int = 700) -> Model:
    """Model trained on ``samples`` (text, lang) and on confirmed sentences of a sample of ``docs``.

    ``max_documents``: bound of the sample of labelled documents, the first by the hash of their key;
    ``max_sentences``: bound of the sentences taken of each language. Both bound only the training.
    """
    df, total = document_frequencies(docs, text)
    idf = np.log((1 + total) / (1 + df)) + 0.1
    seeds = [(words, lang) for value, lang in sorted((r[0], normal_label(r[1])) for r in samples.select("text", "lang").collect() if r[0]) if lang and lang != "zxx" for _, _, words, _ in prose_sentences(value)]
    langs = sorted({lang for _, lang in seeds})
    model = train(seeds, langs, idf, epochs=20, batch=8)
    if not langs:
        return model
    place = F.xxhash64(key)
    share = min(1.0, 2 * max_documents / max(total, 1))  # of the hashes' range, so that no task sends many rows
    near = F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = docs.where(F.col(text).isNotNull() & near).select(text, label).orderBy(place).limit(max_documents).collect()
    pool = [(lang, [s[2:] for s in prose_sentences(r[0])]) for r in sample if (lang := normal_label(r[1])) in langs]
    for step in range(2):
        scores = model.probabilities([words for _, sentences in pool for words, _ in sentences])
        taken: dict[str, dict[tuple[str, ...], None]] = {lang: {} for lang in langs}
        at = 0
        for lang, sentences in pool:
            p = scores[at : at + len(sentences)]
            at += len(sentences)
            own = langs.index(lang)
            others = np.delete(p, own, axis=1).max(1, initial=0.0)
            weight = np.zeros(len(langs))
            for guess, (_, chars) in zip(p.argmax(1), sentences, strict=True):
                weight[guess] += chars
            if not len(sentences) or weight.argmax() != own or (step and others.max() > 0.95):
                continue  # the label is not confirmed, or a further language may be in it
            for (words, _), sure, other in zip(sentences, p[:, own], others, strict=True):
                if sure > (0.02 if step else other) and (len(words) > 3 or _CJK.search(words[0])):
                    taken[lang][tuple(words)] = None
        for lang, held in taken.items():
            spread = sorted(held, key=lambda words: zlib.crc32(" ".join(words).encode()))
            taken[lang] = dict.fromkeys(spread[:max_sentences])
        rows = [(list(words), lang) for lang, held in taken.items() for words in held]
        kept = [r for i, r in enumerate(rows) if i % 5]
        model = train(seeds + kept, langs, idf)
        apart = [r for i, r in enumerate(rows) if i % 5 == 0] or seeds
        model.temperature = calibrate(model, [(words[i : i + 2], lang) for words, lang in apart for i in range(0, len(words), 2)])
    return model


Judged = tuple[str | None, float, list[str], list[tuple[int, int, str, float]]]


def analyse(model: Model, texts: list[str | None], sure: float = 0.5) -> list[Judged]:
    """(language, confidence, further languages, segments) of each text.

    The language is that with the most characters of prose (ties: the first code), zxx without prose, None for a NULL
    or blank text. Neighbouring sentences of one language make a segment (start, end, language, confidence). A further
    language needs a whole sentence of at least three words, or five characters without spaces, of confidence ``sure``.
    A model without languages judges nothing. Near ties go to a language that is clear elsewhere in the text.
    """
    if not model.langs:
        return [(None, 0.0, [], []) for _ in texts]
    found = [None if t is None or not t.strip() else prose_sentences(t) for t in texts]
    p = model.probabilities([s[2] for sentences in found for s in sentences or ()])
    best = p.argmax(1)
    at = 0
    for sentences in found:
        if sentences:
            part = slice(at, at + len(sentences))
            _settle(p[part], np.array([s[3] for s in sentences], dtype=float), best[part])
            at += len(sentences)
    sures = p[np.arange(len(p)), best] if len(p) else p
    at = 0
    out: list[Judged] = []
    for sentences in found:
        if not sentences:
            out.append((None, 0.0, [], []) if sentences is None else ("zxx", 1.0, [], []))
            continue
        out.append(_judge(model.langs, sentences, best[at : at + len(sentences)].tolist(), sures[at : at + len(sentences)].tolist(), sure))
        at += len(sentences)
    return out


def _settle(p: np.ndarray, chars: np.ndarray, best: np.ndarray, clear: float = 0.9, tie: float = 0.7) -> None:
    """Decide near ties for a language that is clear elsewhere in the text, in ``best``; probabilities stay as they are."""
    top = p.max(1)
    plain = top >= clear
    if plain.all() or not plain.any():
        return
    share = (p[plain] * chars[plain, None]).sum(0)
    open_rows = np.flatnonzero(~plain)
    best[open_rows] = np.where(p[open_rows] >= tie * top[open_rows, None], share, -1.0).argmax(1)


def _judge(langs: list[str], sentences: list, best: list[int], sures: list[float], sure: float) -> Judged:
    """The judgement of one text from its sentences' languages and their probabilities."""
    weight: dict[str, float] = {}
    mass: dict[str, float] = {}
    whole: set[str] = set()
    segments: list[tuple[int, int, str, float, float]] = []
    for (start, end, words, chars), number, sure_of in zip(sentences, best, sures, strict=True):
        lang = langs[number]
        weight[lang] = weight.get(lang, 0.0) + chars
        mass[lang] = mass.get(lang, 0.0) + chars * sure_of
        if sure_of >= sure and (len(words) >= 3 or len(_CJK.findall("".join(words))) >= 5):
            whole.add(lang)
        if segments and segments[-1][2] == lang:
            a, _, _, c, n = segments[-1]
            segments[-1] = (a, end, lang, c + sure_of * chars, n + chars)
        else:
            segments.append((start, end, lang, sure_of * chars, float(chars)))
    main = min(weight, key=lambda code: (-weight[code], code))
    return main, mass[main] / weight[main], sorted(whole - {main}), [(a, b, lang, c / n) for a, b, lang, c, n in segments]


IDENTIFIED = "found_lang string, confidence double, other_langs array<string>, segments array<struct<start:bigint,end:bigint,lang:string,confidence:double>>"


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns with found_lang, confidence, other_langs and segments of every document; see ``analyse``.

    NULL and blank texts have a NULL language. Repeated rows are each judged; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "found_lang", "confidence", "other_langs", "segments"]
    segment = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = analyse(held.value, batch.column(len(keep)).to_pylist())
            arrays = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
                pa.array([[dict(zip(("start", "end", "lang", "confidence"), s, strict=True)) for s in f[3]] for f in found], segment),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names)

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).cast("string").alias("l_text")).mapInArrow(run, f"{kept}, {IDENTIFIED}")
