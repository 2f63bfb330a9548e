"""Personal data: exact base patterns, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, map_texts, written

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# No match can begin inside a run of digits: it would have begun at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What an identifier may look like when it misses a base pattern; only a learned context makes it one.
_AT = re.compile(r"@| ?[(\[]at[)\]] ?")
_LOOSE_LOCAL = re.compile(r"[\w.%+-]")
_LOOSE_DOMAIN = re.compile(r"[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]+)*")
_LOOSE = re.compile(
    r"(?P<ip>(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9])(?:[0-9]{1,3}[ .,_-]){3}[0-9]{1,3}(?![0-9]))"
    r"|(?P<phone>(?<![0-9])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9]))"
)
_WORD = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>,;"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each @ outwards: linear in the text's length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in code points, end exclusive; matches that fail a kind's test are dropped."""
    out: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


class Neighbours:
    """The words of a text, for the lexical patterns around its spans. Whole words of any length count, however far away on the line."""

    def __init__(self, text: str):
        self.text = text
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.words]

    def _bare(self, a: int, b: int) -> str:
        return self.text[a:b].lower().strip(_EDGE)

    def before(self, start: int) -> list[str]:
        """Up to two words before ``start`` on its line, the nearest first; what a span is glued to counts as a word."""
        out, at, i = [], start, bisect_left(self.starts, start) - 1
        while i >= 0 and len(out) < 2:
            a, b = self.words[i][0], min(self.words[i][1], start)
            if self.text.find("\n", b, at) >= 0:
                break
            if word := self._bare(a, b):
                out.append(word)
            at, i = a, i - 1
        return out

    def after(self, end: int) -> list[str]:
        """The word after ``end`` on its line, if any."""
        i = max(0, bisect_right(self.starts, end) - 1)
        at = end
        while i < len(self.words):
            a, b = max(self.words[i][0], end), self.words[i][1]
            if b > end:
                if self.text.find("\n", at, a) >= 0:
                    break
                if word := self._bare(a, b).strip(".:!?"):
                    return [word]
                at = b
            i += 1
        return []

    def patterns(self, start: int, end: int) -> list[str]:
        """Lexical patterns around a span: one and two words before it, the one after it, and one on either side."""
        left, right = self.before(start), self.after(end)
        out = ["1 " + left[0]] if left else []
        if len(left) > 1:
            out.append(f"2 {left[1]} {left[0]}")
        if right:
            out.append("+ " + right[0])
        if left and right:
            out.append(f"= {left[0]} _ {right[0]}")
        return out


def loose_emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the loose kind, from each mark outwards: linear in the text's length."""
    out, end = [], 0
    for m in _AT.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and _LOOSE_LOCAL.match(text[start - 1]):
            start -= 1
        domain = _LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            end = domain.end()
            out.append((start, end))
    return out


def loose_spans(text: str, base: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """Possible identifiers outside of all base spans."""
    digits = _DIGIT.search(text)
    if not (digits or "@" in text or "at)" in text or "at]" in text):
        return []
    taken = sorted(s for spans in base.values() for s in spans)
    starts = [a for a, _ in taken]
    most, reach = 0, []
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    found = [("email", *s) for s in loose_emails(text)]
    found += [(m.lastgroup or "", *m.span()) for m in _LOOSE.finditer(text) if m.lastgroup != "phone" or sum(c.isdigit() for c in m[0]) >= 7] if digits else []
    out = []
    for kind, a, b in found:
        i = bisect_right(starts, b - 1) - 1
        if i < 0 or reach[i] <= a:
            out.append((kind, a, b))
    return out


MENTION = "struct<kind: string, known: boolean, start: int, end: int, instance: string, patterns: array<string>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base_sha256, mentions`` of each row, written; ``key`` is the text's hash.

    Mentions are base spans (``known``) and possible identifiers, with their lower-cased text as ``instance`` and the ``patterns`` around them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("known", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sha, rows = [], []
        for text in b.column(2).to_pylist():
            text = text or ""
            base = base_spans(text)
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            found = [(k, True, a, z) for k in KINDS for a, z in base[k]] + [(k, False, a, z) for k, a, z in loose_spans(text, base)]
            near = Neighbours(text) if found else None
            rows.append([{"kind": k, "known": known, "start": a, "end": z, "instance": text[a:z].lower(), "patterns": near.patterns(a, z)} for k, known, a, z in found])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sha, pa.string()), pa.array(rows, pa.list_(item))], ["doc_id", "key", "base_sha256", "mentions"])

    src = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return written(map_texts(src, run, f"doc_id {kind}, key long, base_sha256 string, mentions array<{MENTION}>"))


def learn_patterns(scanned: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """``kind, pattern, score`` of the contexts that point to one kind of identifier with high confidence, from a ``scan``.

    The graph joins patterns and instances. Base spans are seeds of score 1. In each round a pattern scores
    the summed score of its kind's instances over all instances it meets (of any kind, plus 1), and an
    instance the best of its patterns; instances that reach ``confidence`` count as members in the next round. A
    pattern needs ``support`` different instances, whatever the input's size: five are the fewest that can score 0.8 (5 of 5 + 1). Both
    tables are added up by key before the shuffle; a very common pattern is one row for each task. No mention: no pattern.
    """
    every = scanned.select(F.explode("mentions").alias("m")).select("m.kind", "m.instance", "m.known", F.explode("m.patterns").alias("pattern"))
    edges = written(every.groupBy("kind", "instance", "pattern").agg(F.max(F.col("known").cast("double")).alias("seed")))
    scored, good = edges.withColumn("score", F.col("seed")), None
    for i in range(rounds):
        counts = scored.groupBy("pattern").agg(F.count("*").alias("all"))
        per = scored.groupBy("kind", "pattern").agg(F.sum("score").alias("hits")).where(F.col("hits") >= support)
        last, good = good, written(
            per.join(counts, "pattern").withColumn("score", F.col("hits") / (F.col("all") + 1)).where(F.col("score") >= confidence).select("kind", "pattern", "score")
        )
        if last is not None:
            forget(last)
        if i + 1 < rounds:
            best = edges.where("seed = 0").join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("score").alias("found"))
            before, scored = scored, written(edges.join(best, ["kind", "instance"], "left").withColumn("score", F.greatest("seed", F.coalesce("found", F.lit(0.0)))).drop("found"))
            if before is not edges and i:
                forget(before)
    return good


#: Tables of up to this many rows are broadcast; larger ones are joined by a shuffle.
FEW = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def accepted(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """``key, added``: for each text the possible identifiers (kind, start, end) that have a learned pattern."""
    open_ = scanned.select("key", F.explode(F.filter("mentions", lambda m: ~m["known"])).alias("m"))
    open_ = open_.select("key", "m.kind", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    hits = open_.join(_small(patterns.select("kind", "pattern")), ["kind", "pattern"]).select("key", "kind", "start", "end").distinct()
    return written(hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added")))


def find_personal_data(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Personal data in every whole text of ``docs`` (columns doc_id, text).

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found``: the counts and digest
    are those of the base patterns, ``spans`` holds base spans and those that learned contexts add
    (``n_found`` of them), by kind, then start. Null and empty texts have none. Rows are independent: repeated
    rows and ids give a row each. An empty table gives an empty one. Extra columns are ignored.
    """
    scanned = scan(docs.select("doc_id", "text"))
    added = accepted(scanned, learn_patterns(scanned) if patterns is None else patterns)
    rows = scanned.join(_small(added), "key", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind: string, start: int, end: int>>")))
    known = F.filter("mentions", lambda m: m["known"])
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    place = lambda m: F.struct(rank(m["kind"]).alias("k"), m["start"].alias("a"), m["end"].alias("z"), m["kind"].alias("kind"))
    every = F.array_sort(F.concat(F.transform(known, place), F.transform("added", place)))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["z"].cast("string"))), ",")
    of = lambda kind: lambda m: m["known"] & (m["kind"] == kind)
    counts = [F.size(F.filter("mentions", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, "base_sha256", spans.alias("spans"), F.size("added").cast("long").alias("n_found"))


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """``text`` with each span replaced by its kind, such as ``<EMAIL>``; of overlapping spans the first, longest."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        elif b > at:
            pass  # its tail goes with the span before
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars`` set anew where that column is there.

    Null and empty texts stay as they are, as do all other columns, whatever their names. Repeated rows are masked alike. An
    empty table gives an empty one.
    """
    scanned = scan(docs.select("doc_id", "text"))
    added = accepted(scanned, learn_patterns(scanned) if patterns is None else patterns)
    forget(scanned)
    at, more = docs.columns.index("text"), fresh(docs, "added")
    own = fresh(docs, "key")
    more_of = _small(added.select(F.col("key").alias(own), F.col("added").alias(more)))
    rows = docs.join(more_of, F.xxhash64("text") == F.col(own), "left").select(*docs.columns, more)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t, found in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            if t:
                spans = base_spans(t)
                for s in found or ():
                    spans[s["kind"]].append((s["start"], s["end"]))
                t = masked(t, spans)
            texts.append(t)
        kept = [b.column(i) if i != at else pa.array(texts, b.schema.field(at).type) for i in range(b.num_columns - 1)]
        return pa.RecordBatch.from_arrays(kept, schema=pa.schema([b.schema.field(i) for i in range(b.num_columns - 1)]))

    out = map_texts(rows, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
