"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The nodes of a document's graph are its tokens that hold a digit or an at sign, and later mentions of the name before an
at sign. Neighbouring tokens share chain potentials; a token and the one before it with the same core, the same seven or
more digits or the same name share a skip potential, so a mention far away draws the label of its twin. Linking each
occurrence to the one before keeps the edges linear in the tokens. Tokens in a pattern's span have that label as
evidence; loopy sum-product messages settle the others, for all documents of a run at once.

Weights come from a bounded sample, by pseudo-likelihood. Its labels are the patterns' own spans, values that an assignment
to a telling name gives away (secrets, which no pattern at work looks for), and mentions put in for learning: the name of an
address without its domain, a number without its punctuation, and likewise of tokens that are no personal data. No pattern
finds such a mention, so its label has to come over the skip link.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import runs

KINDS = ("email", "ip", "card", "phone")
#: What a token may be besides nothing; a secret is found by the field alone.
LABELS = (*KINDS, "secret")
#: Documents drawn for learning; those without a digit or an at sign, and the long, are left out, so 100 MB at most are read.
SAMPLE, SAMPLE_CHARS = 5_000, 20_000
#: Characters before a token in which a telling name counts for it.
NEAR = 24
#: An added span needs this posterior.
SURE = 0.9
ROUNDS = 20
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("base", IntegerType())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SEED = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"\S+")
_TELLING = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|(?:api|access|private)[_ -]?key)\W*$")
_ASSIGNED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|(?:api|access|private)[_ -]?key)["']?\s?[:=]\s?["']?([A-Za-z0-9_/+-]{16,})""")
_EDGE = "()[]{}<>\"'`.,;:!?*#$%&=/\\|~^_-"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign with a name before it and a dotted domain behind it, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield first, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start. A match that fails its test is dropped."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


@dataclass
class Graph:
    """Nodes of several documents; edges (i, j, skip) with i before j."""

    where: list[tuple[int, int, int]] = field(default_factory=list)
    features: list[list[float]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, doc: int, text: str, spans: list[tuple[str, int, int]]) -> None:
        """Adds a document; labels are 0 outside the spans, else 1 + the kind's place in LABELS. Time linear in the text."""
        tokens, done = [], 0
        for m in _SEED.finditer(text):
            if m.start() >= done:
                first, done = m.start(), m.end()
                while first and not text[first - 1].isspace():
                    first -= 1
                while done < len(text) and not text[done].isspace():
                    done += 1
                tokens.append((first, done))
        names = {name.lower() for kind, a, b in spans if kind == "email" and len(name := text[a:b].split("@")[0]) >= 6}
        if names:
            tokens += [m.span() for m in _TOKEN.finditer(text) if m[0].strip(_EDGE).lower() in names]
        tokens, inside, last, seen = sorted(set(tokens)), sorted((a, b, 1 + LABELS.index(k)) for k, a, b in spans), None, {}
        k = 0
        for first, end in tokens:
            core = text[first:end]
            start = first + len(core) - len(core.lstrip(_EDGE))
            core = core.strip(_EDGE)
            if not core:
                continue
            node, stop = len(self.where), start + len(core)
            while k < len(inside) and inside[k][1] <= start:
                k += 1
            at = k
            while at < len(inside) and inside[at][0] < stop and inside[at][1] <= start:
                at += 1
            label = inside[at][2] if at < len(inside) and inside[at][0] < stop else 0
            self.where.append((doc, start, stop))
            self.labels.append(label)
            self.features.append(_features(core, text[max(0, start - NEAR) : start]))
            if last is not None and text[last : first].isspace():
                self.edges.append((node - 1, node, 0))
            last = end
            digits = "".join(_DIGIT.findall(core))
            for key in {core.lower(), "#" + digits if len(digits) >= 7 else "", core.split("@")[0].lower() if len(core.split("@")[0]) >= 6 else ""} - {""}:
                if key in seen and seen[key] != node and (seen[key], node, 0) not in self.edges[-1:]:
                    self.edges.append((seen[key], node, 1))
                seen[key] = node


def _features(core: str, before: str) -> list[float]:
    """Of a token without the marks around it, and of the characters before it."""
    digits = len(_DIGIT.findall(core))
    letters = sum(map(str.isalpha, core))
    dots, parts = core.count("."), core.split(".")
    quad = dots == 3 and all(x.isascii() and x.isdigit() for x in parts)
    mixed = len(core) >= 16 and digits >= 3 and letters >= 3 and not dots and "@" not in core
    return [
        1.0, float("@" in core), float("@" in core and bool(_DOMAIN.fullmatch(core.rpartition("@")[2]))), float(digits == 0), float(1 <= digits <= 3),
        float(4 <= digits <= 7), float(8 <= digits <= 12), float(13 <= digits <= 15), float(16 <= digits <= 19), float(digits > 19), float(letters > 0), float(letters > digits),
        float(quad), float(quad and all(len(x) <= 3 and int(x) <= 255 for x in parts)), float(core[:1] == "+" or before[-1:] == "+"), float("-" in core), float(dots > 0),
        float(13 <= digits <= 19 and _luhn("".join(_DIGIT.findall(core)))), float(digits == 4 and len(core) == 4),
        float(mixed), float(bool(_TELLING.search(before))), float(mixed and bool(_TELLING.search(before))),
    ]


WIDTH = len(_features("0", ""))


@dataclass
class Field:
    """Weights: a token's features by label, label to next label along the chain, agreement along a skip edge."""

    token: np.ndarray
    chain: np.ndarray
    skip: float

    def posteriors(self, graph: Graph, evidence: np.ndarray) -> np.ndarray:
        """Beliefs of each node after loopy sum-product; evidence: its label where at least 1, else 0 for unknown."""
        k = len(LABELS) + 1
        own = np.array(graph.features).reshape(-1, WIDTH) @ self.token
        known = evidence > 0
        own[known] = -50.0
        own[known, evidence[known]] = 0.0
        if not graph.edges:
            return _soft(own)
        i, j, skip = np.array(graph.edges).T
        agree = self.skip * np.eye(k)
        bond = np.where(skip[:, None, None] == 1, agree, self.chain)  # [edge, label of i, label of j]
        right, left = np.zeros((len(i), k)), np.zeros((len(i), k))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, j, right)
            np.add.at(belief, i, left)
            to_right = _norm(_lse((belief[i] - left)[:, :, None] + bond, 1))
            to_left = _norm(_lse((belief[j] - right)[:, None, :] + bond, 2))
            right, left = (right + to_right) / 2, (left + to_left) / 2
        belief = own.copy()
        np.add.at(belief, j, right)
        np.add.at(belief, i, left)
        return _soft(belief)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _norm(x: np.ndarray) -> np.ndarray:
    return x - _lse(x, 1)[:, None]


def _soft(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def with_mentions(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with mentions of half its spans, and of other numbers, put behind it, and all its spans for learning.

    An address is mentioned by its name, a phone number by its last digits; a number that is none by its digits. Which half
    depends on the text alone.
    """
    spans = base_spans(text)
    spans += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if not any(a < m.end(1) and b > m.start(1) for _, a, b in spans)]
    graph, more = Graph(), []
    graph.add(0, text, spans)
    for (_, a, b), label in zip(graph.where, graph.labels, strict=True):
        core = text[a:b]
        digits = "".join(_DIGIT.findall(core))
        kind = LABELS[label - 1] if label else None
        if zlib.crc32(core.encode()) % 2:
            continue
        if kind == "email" and len(core.split("@")[0]) >= 6:
            more.append((kind, core.split("@")[0]))
        elif kind == "phone" and len(digits) >= 7 or kind is None and len(digits) >= 7 and "@" not in core:
            more.append((kind, digits))
        elif kind == "secret":
            more.append((kind, core))
    parts = [text]
    at = len(text)
    for kind, mention in more:
        parts.append(f" . {mention}")
        at += 3
        if kind:
            spans.append((kind, at, at + len(mention)))
        at += len(mention)
    return "".join(parts), spans


def fit(texts: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximises the pseudo-likelihood of the labels: each node given its neighbours' labels."""
    graph, k = Graph(), len(LABELS) + 1
    for n, text in enumerate(texts):
        graph.add(n, *with_mentions(text))
    x, y = np.array(graph.features).reshape(-1, WIDTH), np.array(graph.labels, int)
    i, j, skip = np.array(graph.edges, int).reshape(-1, 3).T
    hot = np.eye(k)[y]
    prev, after, twin = np.zeros((len(y), k)), np.zeros((len(y), k)), np.zeros((len(y), k))
    c, s = skip == 0, skip == 1
    np.add.at(prev, j[c], hot[i[c]])
    np.add.at(after, i[c], hot[j[c]])
    np.add.at(twin, j[s], hot[i[s]])
    np.add.at(twin, i[s], hot[j[s]])
    token, chain, agree = np.zeros((WIDTH, k)), np.zeros((k, k)), 1.0
    token[0, 0] = 1.0
    for _ in range(steps if len(y) else 0):
        p = _soft(x @ token + prev @ chain + after @ chain.T + agree * twin)
        gap = (hot - p) / len(y)
        token += rate * (4 * x.T @ gap - decay * token)
        chain += rate * (2 * (prev.T @ gap + gap.T @ after) - decay * chain)
        agree += rate * float((gap * twin).sum())
    return Field(token, chain, agree)


def learned(docs: DataFrame) -> Field:
    """Weights from about SAMPLE documents drawn by a hash of doc_id and text: the draw, not the input, bounds what comes here."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    few = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 32)) < share * (1 << 32))
    rows = few.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("text").distinct().collect()
    return fit(sorted(r["text"] for r in rows))


def find_spans(texts: list[str | None], field_: Field) -> list[list[tuple[str, int, int, int]]]:
    """(kind, start, end, 1 if a pattern's own) of each text, by kind as in LABELS, then start."""
    graph, out = Graph(), []
    for n, text in enumerate(texts):
        spans = base_spans(text) if text else []
        out.append([(*x, 1) for x in spans])
        if text and _SEED.search(text):
            graph.add(n, text, spans)
    labels = np.array(graph.labels, int)
    if len(labels) and not labels.all():
        p = field_.posteriors(graph, labels)
        best = np.where(labels == 0, p[:, 1:].argmax(1) + 1, 0)
        for node in np.flatnonzero((labels == 0) & (p[np.arange(len(p)), best] >= SURE)):
            doc, a, b = graph.where[node]
            mine = out[doc]
            if not any(x < b and y > a for _, x, y, _ in mine):
                mine.append((LABELS[best[node] - 1], a, b, 0))
    order = {k: i for i, k in enumerate(LABELS)}
    return [sorted(x, key=lambda s: (order[s[0]], s[1])) for x in out]


def detect(docs: DataFrame, field_: Field) -> DataFrame:
    """Adds the column spans (SPANS) to docs, of its column text; other columns pass.

    Null and empty texts have no spans. Offsets are code points, the end exclusive. No shuffle; a document is whole in one
    task, and its graph is linear in its tokens. A column that is already called spans is replaced.
    """
    docs = docs.drop("spans")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                found = find_spans(run.column("text").to_pylist(), field_)
                rows = [[{"kind": k, "first": a, "last": b, "base": c} for k, a, b, c in x] for x in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("base", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(rows, kind)], [*run.schema.names, "spans"])

    return docs.mapInArrow(tag, StructType([*docs.schema.fields]).add("spans", SPANS))


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, base_sha256 of those spans, spans with the added ones of these kinds.

    Then secrets, the spans of that kind, and n_private, how many spans of any kind there are. Null and empty texts have none;
    repeated rows and null ids each give a row of their own; other columns are ignored; an empty table gives an empty result.
    """
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), learned(docs)).drop("text")
    base = F.filter("spans", lambda s: s["base"] == 1)
    listed, secret = F.filter("spans", lambda s: s["kind"] != "secret"), F.filter("spans", lambda s: s["kind"] == "secret")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    sums = [F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(listed).alias("spans"), _joined(secret).alias("secrets"), F.size("spans").cast("long").alias("n_private")]
    return found.select("doc_id", *counts, *sums)


def redact(docs: DataFrame, field_: Field) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets, and n_chars made anew where it is there."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                texts, out = run.column("text").to_pylist(), []
                for text, spans in zip(texts, find_spans(texts, field_), strict=True):
                    done, parts = 0, []
                    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if b > done:
                            parts += [text[done : max(a, done)], f"<{kind.upper()}>"] if a >= done else []
                            done = b
                    out.append(text if not spans else "".join([*parts, text[done:]]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else c for n, c in zip(run.schema.names, run.columns, strict=True)], run.schema.names)

    plain = docs.withColumn("text", F.col("text").cast("string"))
    masked = plain.mapInArrow(mask, plain.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def spans_sha256(spans: list[tuple[str, int, int]]) -> str:
    """What base_sha256 is of these spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
