"""Problem 9: personal information inside free text, by a character-level bidirectional LSTM with CRF transitions.

The tagger is fitted by ``pii_train`` in numpy and kept as ``pii_model.npz``. Texts are read whole, in overlapping
windows; the windows are decoded by Viterbi and their spans reconciled over the text. A check of the form of each
span (the characters such a span may consist of, word borders, surrounding punctuation) then settles its ends.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import spread

KINDS = ("name", "email", "phone", "id_number", "address")
#: Tags: 0 outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
MODEL_FILE = os.path.join(os.path.dirname(__file__), "pii_model.npz")
#: Characters per window and shared with the next one; windows decoded together.
WINDOW, OVERLAP, BATCH = 384, 64, 192

_ALPHABET = " \n\t" + "".join(map(chr, range(33, 127))) + "äöüßéèêëàâîïôûùçñáíóúÄÖÜÉÈÁÍÓÚÑº–—’“”«»…"
_CODE = {c: i + 5 for i, c in enumerate(_ALPHABET)}
#: Codes: 0 padding, 1 other lower, 2 other upper, 3 other space, 4 any other character.
VOCABULARY = len(_ALPHABET) + 5
_PLAIN = {"‑": "-", "‐": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ", "＠": "@", "．": ".", "＋": "+", "（": "(", "）": ")", "－": "-", **{chr(0xFF10 + i): str(i) for i in range(10)}}


def _code(c: str) -> int:
    c = _PLAIN.get(c, c)
    if c in _CODE:
        return _CODE[c]
    return 1 if c.islower() or (c.isalpha() and not c.isupper()) else 2 if c.isupper() else 3 if c.isspace() else 4


_BASIC = np.array([_code(chr(i)) for i in range(0x3000)], np.int16)
_WIDE = np.array([_code(chr(i)) for i in range(0xFF00, 0x10000)], np.int16)


def encode(text: str) -> np.ndarray:
    """One code per code point of ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _BASIC[np.minimum(points, 0x2FFF)]
    wide = np.nonzero(points >= 0x3000)[0]
    for i in wide:
        p = int(points[i])
        codes[i] = _WIDE[p - 0xFF00] if 0xFF00 <= p < 0x10000 else _code(chr(p))
    return codes


def load_model(path: str = MODEL_FILE) -> dict[str, np.ndarray]:
    with np.load(path) as found:
        return {k: found[k].astype(np.float32) for k in found.files}


def _run(table: np.ndarray, codes: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """Hidden states (steps, windows, H) of one direction; ``table`` holds the input part of the gates per code."""
    steps, n = codes.shape
    hidden = wh.shape[0]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    out = np.empty((steps, n, hidden), np.float32)
    gates = np.empty((n, 4 * hidden), np.float32)
    for t in range(steps):
        np.matmul(h, wh, out=gates)
        gates += table[codes[t]]
        np.tanh(gates, out=gates)  # the weights of the three sigmoid gates are halved: sigmoid(x) = (tanh(x/2) + 1) / 2
        g = gates[:, 3 * hidden :]
        ifo = gates[:, : 3 * hidden]
        ifo += 1
        ifo *= 0.5
        c *= ifo[:, hidden : 2 * hidden]
        c += ifo[:, :hidden] * g
        h = np.tanh(c)
        h *= ifo[:, 2 * hidden :]
        out[t] = h
    return out


def emissions(model: dict[str, np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tag scores (steps, windows, TAGS) of padded windows ``codes`` (steps, windows)."""
    hidden = model["f_wh"].shape[0]
    half = np.r_[np.full(3 * hidden, 0.5, np.float32), np.ones(hidden, np.float32)]
    forward = _run((model["emb"] @ model["f_wx"] + model["f_b"]) * half, codes, model["f_wh"] * half)
    steps, n = codes.shape
    turn = lengths[None, :] - 1 - np.arange(steps)[:, None]
    turn = np.where(turn >= 0, turn, np.arange(steps)[:, None])
    cols = np.arange(n)[None, :]
    backward = _run((model["emb"] @ model["b_wx"] + model["b_b"]) * half, codes[turn, cols], model["b_wh"] * half)[turn, cols]
    return forward @ model["out"][:hidden] + backward @ model["out"][hidden:] + model["out_b"]


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags (steps, windows); beyond a window's length 0."""
    steps, n, k = scores.shape
    best = start + scores[0]
    back = np.zeros((steps, n, k), np.int8)
    for t in range(1, steps):
        step = best[:, :, None] + trans[None]
        arg = step.argmax(1)
        new = np.take_along_axis(step, arg[:, None, :], 1)[:, 0] + scores[t]
        live = (t < lengths)[:, None]
        back[t] = np.where(live, arg, np.arange(k))
        best = np.where(live, new, best)
    tags = np.zeros((steps, n), np.int8)
    now = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        tags[t] = np.where(t < lengths, now, 0)
        now = np.where(t < lengths, back[t, rows, now], now)
    return tags


def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one window's tags."""
    found = []
    at = 0
    on = np.nonzero(tags)[0]
    while at < len(on):
        s = on[at]
        kind = (tags[s] - 1) // 2
        e = s + 1
        while e < len(tags) and tags[e] == 2 + 2 * kind:
            e += 1
        found.append((int(kind), int(s), int(e)))
        at = np.searchsorted(on, e)
    return found


def tag_texts(model: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans (kind, start, end) of each whole text.

    A span that touches the border between two windows is decided by the window that sees more around it: of
    overlapping spans the one farther from its window's cut ends stays, ties go to the longer and then the earlier one.
    """
    codes = [encode(t) for t in texts]
    windows = [(i, s) for i, c in enumerate(codes) for s in range(0, max(1, len(c) - OVERLAP), WINDOW - OVERLAP)]
    windows.sort(key=lambda w: (len(codes[w[0]]) - w[1] if len(codes[w[0]]) - w[1] < WINDOW else WINDOW))
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for b in range(0, len(windows), BATCH):
        part = windows[b : b + BATCH]
        lengths = np.array([min(WINDOW, len(codes[i]) - s) for i, s in part])
        block = np.zeros((max(1, int(lengths.max())), len(part)), np.int16)
        for k, (i, s) in enumerate(part):
            block[: lengths[k], k] = codes[i][s : s + WINDOW]
        tags = viterbi(emissions(model, block, lengths), lengths, model["trans"], model["start"])
        for k in np.nonzero(tags.any(0))[0]:
            i, s = part[k]
            for kind, a, e in _spans(tags[:, k]):
                left = WINDOW if s == 0 else a
                right = WINDOW if s + lengths[k] == len(codes[i]) else lengths[k] - e
                found[i].append((min(left, right, WINDOW), kind, a + s, e + s))
    out = []
    for spans in found:
        kept: list[tuple[int, int, int]] = []
        for _, kind, s, e in sorted(spans, key=lambda x: (-x[0], x[2] - x[3], x[2], x[1])):
            if all(e <= a or s >= z for _, a, z in kept):
                kept.append((kind, s, e))
        out.append(sorted(kept, key=lambda x: x[1]))
    return out


_TO_PLAIN = str.maketrans(_PLAIN | {"–": "-", "—": "-"})
_AT = r"(?:\s?@\s?|\s?[(\[](?:at|ät)[)\]]\s?|\s(?:at|ät|arroba|arobase)\s)"
_DOT = r"(?:\.|\s?[(\[]dot[)\]]\s?|\s(?:dot|punto|punkt|point)\s)"
_EMAIL = re.compile(rf"[^\W_][\w.+-]*{_AT}[^\W\d_][\w-]*(?:{_DOT}[^\W\d_][\w-]+)+(?![\w@])", re.I)
_FILE_END = re.compile(r"\.(?:webp|png|jpe?g|gif|heic|mp4|mov|lrv|thm)$", re.I)
# The words for zero to nine in English, German, French and Spanish.
_DIGIT_WORDS = frozenset(
    "zero one two three four five six seven eight nine null eins zwei drei vier fünf sechs sieben acht neun "
    "zéro un deux trois quatre cinq six sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve".split()
)
_PLACE_AND_CODE = re.compile(r" [^\W\d_]+ (?:\d{5}|[A-Z]{2}\d \d[A-Z]{2})\b", re.I)


def _to_words(t: str, s: int, e: int) -> tuple[int, int]:
    """Ends moved out to the borders of the words they cut."""
    while s > 0 and t[s - 1].isalnum() and t[s].isalnum():
        s -= 1
    while e < len(t) and t[e - 1].isalnum() and t[e].isalnum():
        e += 1
    return s, e


def _spoken(t: str, s: int, e: int) -> tuple[int, int]:
    """A number spoken digit by digit, with the digit words next to it that were left out."""
    if not all(w in _DIGIT_WORDS for w in t[s:e].lower().split()):
        return s, e
    while (m := re.search(r"(\w+) $", t[max(0, s - 12) : s])) and m[1].lower() in _DIGIT_WORDS:
        s -= len(m[0])
    while (m := re.match(r" (\w+)", t[e : e + 12])) and m[1].lower() in _DIGIT_WORDS:
        e += len(m[0])
    return s, e


def settle(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """The spans with settled ends, without those that can't be what they were tagged as."""
    t = text.translate(_TO_PLAIN)
    out: list[tuple[str, int, int]] = []
    last = 0
    for kind, s, e in spans:
        s = max(s, last)
        while s < e and not t[s].isalnum() and not (KINDS[kind] in ("phone",) and t[s] in "+("):
            s += 1
        if s >= e:
            continue
        name = KINDS[kind]
        if name == "email":
            low = max(last, s - 80)
            m = next((m for m in _EMAIL.finditer(t, low, min(len(t), e + 80)) if m.start() < e and m.end() > s), None)
            if m is None or _FILE_END.search(m[0]):
                continue
            s, e = m.start(), m.end()
        else:
            s, e = _to_words(t, max(s, last), e)
            while e > s and not t[e - 1].isalnum() and not (name == "address" and t[e - 1] == "." and re.search(r"\b(?:st|rd|str)\.$", t[s:e], re.I)) and not (name == "phone" and t[e - 1] == ")" and "(" in t[s:e]):
                e -= 1
            body = t[s:e]
            if name == "address":
                if re.search(r"\b(?:st|rd)$|str$", body, re.I) and t[e : e + 1] == ".":
                    e += 1
                if not re.search(r"\d", body) or not re.search(r"[^\W\d]{3}", body):
                    continue
                if m := _PLACE_AND_CODE.match(t, e):  # a town of two words that was cut before its postcode
                    e = m.end()
            elif name in ("phone", "id_number") and s > 1 and t[s - 1] == "." and t[s - 2].isdigit():
                continue  # the end of a version or another dotted number
            elif name == "phone":
                s, e = _spoken(t, s, e)
                body = t[s:e]
                if body.count("(") > body.count(")"):
                    if body.startswith("("):
                        s += 1
                    elif t[e : e + 1] == ")":
                        e += 1
                if s > 0 and t[s] != "+" and t[s - 1] == "+":
                    s -= 1
                elif s > 0 and t[s - 1] == "(" and ")" in body and "(" not in body:
                    s -= 1
                if sum(c.isdigit() for c in body) < 7 and len(re.findall(r"[^\W\d]+", body)) < 7:
                    continue
            elif name == "id_number":
                if sum(c.isdigit() for c in body) < 5:
                    continue
            else:
                if body[-2:].lower() == "'s" or body[-2:].lower() == "’s":
                    e -= 2
                    body = t[s:e]
                if re.search(r"\d|[@_/]", body) or not re.search(r"[^\W\d_]{2}", body):
                    continue
        if e > s:
            out.append((name, s, e))
            last = e
    return out


def find(texts: list[str], model: dict[str, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    return [settle(t, spans) for t, spans in zip(texts, tag_texts(model, texts), strict=True)]


def personal_spans(docs: DataFrame, id_col: str, text_col: str, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``(id, pii_type, start_pos, end_pos)``: every occurrence in every text; positions count code points from 0, the end is exclusive.

    Null and empty texts and null ids give no rows; repeated rows count once per id and text. Equal texts are tagged
    once per batch. Texts of any length are read whole, in windows.
    """
    weights = model or load_model()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            distinct = list(dict.fromkeys(texts))
            spans = dict(zip(distinct, find(distinct, weights), strict=True))
            rows = [(i, *s) for i, t in zip(ids, texts, strict=True) for s in spans[t]]
            i, k, s, e = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["id", "pii_type", "start_pos", "end_pos"])

    texts = docs.where(F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return spread(texts, "id").mapInArrow(tag, "id bigint, pii_type string, start_pos int, end_pos int").distinct()


def redacted(docs: DataFrame, id_col: str, text_col: str, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[TYPE]`` and ``pii_count``; all else, null and empty texts too, stays as it is."""
    weights = model or load_model()
    names = docs.columns
    at = names.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            distinct = list(dict.fromkeys(t for t in texts if t))
            spans = dict(zip(distinct, find(distinct, weights), strict=True))
            new = [mask_text(t, spans[t]) if t else t for t in texts]
            counts = [len(spans[t]) if t else 0 for t in texts]
            columns = [pa.array(new, b.column(at).type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*names, "pii_count"])

    return spread(docs, id_col).mapInArrow(mask, docs.withColumn("pii_count", F.lit(0)).schema)


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])
