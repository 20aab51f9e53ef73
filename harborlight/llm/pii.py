"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, and a span classifier decides.

Base spans (emails, IP addresses, card and phone numbers) follow fixed patterns and always stay. Every finder is linear in
the text, whatever it holds: it starts at what a kind cannot do without (an @, a plus, a run of digits) and passes each
character a fixed number of times.

Further candidates come from looser shapes: numbers within longer runs of digits, spelled-out addresses, IPv6, phones without
a plus. On each candidate, base ones included, six labelers vote yes, no or not at all: regex, checksum, gazetteer, context,
boundary and layout. Votes and a few bits of shape make a pattern; patterns are counted over all documents (at most
KINDS * 3^6 * 2^4 of them, so the counts have a fixed bound), and expectation-maximisation with a weak prior estimates how
reliable each labeler is for each kind. Its posteriors are the soft labels of a logistic regression on votes and shape, the
final classifier; candidates that it finds likelier than `least` are added where no base or likelier span of the kind is.

Defined cases: a null, empty or clean text has no spans, counts of zero and the digest of an empty list; offsets are code
points, ends exclusive; repeated rows and null ids are rows like any other; spans of different kinds may overlap; ties between
candidates go to the longer, then the earlier; an empty table gives an empty result; columns of any name are carried in a
struct, and ours replace those of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import carried, unpacked, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("regex", "checksum", "gazetteer", "context", "boundary", "layout")
ABSTAIN, NO, YES = range(3)
SHAPES = 4
#: Characters before a span that its context is read from, and a span's probability to be added.
CONTEXT, LEAST = 48, 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]++")
SPELLED = re.compile(r" ?[(\[]at[)\]] ?| at ", re.IGNORECASE)
HOST = re.compile(r"[a-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[a-z0-9-]{1,63}){1,4}", re.IGNORECASE)
SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
GROUPED = re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
CALLED = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")

#: Gazetteers: endings of hosts, and calling codes of countries; fixed values.
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app eu de fr es it nl be at ch uk ie pt pl se no dk fi us ca mx br ar cl au nz jp cn in za".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Words before a span that speak for a kind, and words that speak against any; English, German, French, Spanish.
FOR = tuple(
    re.compile(rf"\b(?:{words})\b", re.IGNORECASE)
    for words in (
        "e-?mails?|mail|contact|write|reach|kontakt|courriel|correo|escriba",
        "ip|ipv[46]|host|server|address|gateway|adresse|serveur|servidor|addr",
        "cards?|visa|mastercard|amex|credit|debit|kreditkarte|karte|carte|tarjeta|payment|pan",
        "phones?|tel|telephone|call|fax|mobile|cell|telefon|anruf|appel|llame|tel[eé]fono|portable",
    )
)
AGAINST = re.compile(r"\b(?:version|isbn|issn|order|invoice|sku|serial|token|hash|build|section|page|figure|id|nr|number|code|bestellung|commande|pedido)\b", re.IGNORECASE)
LETTER = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def joined(text: str) -> str:
    return "".join(NUMBER.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers each of a dotted run; a run of fewer has none, whatever digit it starts at."""
    out = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = [p.span() for p in NUMBER.finditer(text, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                if all(small(text[a:b]) for a, b in parts[i : i + 4]):
                    out.append((parts[i][0], parts[i + 3][1]))
    return out


def cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Cards, and the runs of digits that are none."""
    good, rest = [], []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = joined(m[0]) if m.end() - m.start() <= 37 else ""
            (good if 16 <= len(digits) <= 19 and luhn(digits) else rest).append(m.span())
    return good, rest


def phones(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Phone numbers, and the matches that have too few or too many digits."""
    good, rest = [], []
    for m in PLUS.finditer(text):
        (good if 8 <= len(joined(m[0])) <= 15 else rest).append(m.span())
    return good, rest


def base(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns' spans."""
    text = text or ""
    return [(k, a, b) for k, found in enumerate((emails(text), addresses(text), cards(text)[0], phones(text)[0])) for a, b in found]


def loose(text: str) -> Iterator[tuple[int, int, int]]:
    """Candidates beyond the base; each shape has a bounded length, so the work is linear."""
    for m in SPELLED.finditer(text):
        host = HOST.match(text, m.end())
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        if host and start < m.start():
            yield EMAIL, start, host.end()
    if not NUMBER.search(text):
        return
    for m in SIX.finditer(text):
        yield IP, *m.span()
    for a, b in cards(text)[1]:
        groups = [g.span() for g in NUMBER.finditer(text, a, b)]
        for i in range(len(groups)):
            size = 0
            for start, end in groups[i : i + 5] if groups[i][1] - groups[i][0] >= 4 else ():  # as cards are printed
                size += end - start
                if size > 19:
                    break
                if size >= 13:
                    yield CARD, groups[i][0], end
    for m in GROUPED.finditer(text):
        yield PHONE, *m.span()
    for m in CALLED.finditer(text):
        yield PHONE, *m.span()


def votes(text: str, kind: int, start: int, end: int, fixed: bool) -> int:
    """The pattern of a span: kind, six votes and the bits of its shape, as one number."""
    span = text[start:end]
    digits = joined(span)
    before = text[max(0, start - CONTEXT) : start]
    say = lambda yes, no: YES if yes else NO if no else ABSTAIN
    apart = not (start and LETTER.match(text, start - 1)) and not LETTER.match(text, end)
    groups = [len(g) for g in NUMBER.findall(span)]
    if kind == EMAIL:
        ending = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        checks, listed, laid = say(True, False) if ending.isalpha() else NO, say(ending in ENDINGS, len(ending) > 6), say(fixed, False)
    elif kind == IP:
        four = "." in span
        parts = span.split(".") if four else []
        checks = say(not four or all(p == p.lstrip("0") or p == "0" for p in parts), True)
        listed, laid = say(four and parts[0].lstrip("0") not in ("", "255"), four), say(not four or max(groups) > 2, all(n == 1 for n in groups))
    elif kind == CARD:
        first = digits[:2]
        checks = say(luhn(digits), True)
        listed = say(digits[0] == "4" or "51" <= first <= "55" or "22" <= first <= "27" or first in ("34", "37", "35", "36", "38", "60", "62", "65"), True)
        laid = say(groups in ([len(digits)], [4] * 4, [4, 6, 5]), len(groups) > 3)
    else:
        code = NUMBER.match(span, 1)[0] if span[0] == "+" else ""
        checks = say(8 <= len(digits) <= 15, True)
        listed = say(any(code[:n] in CALLING for n in (1, 2)), bool(code))
        laid = say(span[0] == "+" and len(groups) > 1 or "(" in span, len(set(groups)) == 1)
    shaped = fixed or kind == CARD and 16 <= len(digits) <= 19 and laid == YES or kind == PHONE and span[0] == "+"
    given = (say(shaped, False), checks, listed, say(FOR[kind].search(before), AGAINST.search(before)), say(apart, True), laid)
    shape = (len(digits) >= 12, any(not c.isalnum() for c in span), not before or before[-1] in "\n:;,|=\"'([", end - start > 24)
    code = kind
    for v in given:
        code = code * 3 + v
    for bit in shape:
        code = code * 2 + bit
    return code


def decoded(code: int) -> tuple[int, list[int], list[int]]:
    """(kind, votes, shape) of a pattern."""
    shape, given = [], []
    for _ in range(SHAPES):
        code, bit = divmod(code, 2)
        shape.append(bit)
    for _ in LABELERS:
        code, v = divmod(code, 3)
        given.append(v)
    return code, given[::-1], shape[::-1]


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, pattern) of a text, base spans first; of equal spans one."""
    if not text:
        return []
    fixed = base(text)
    seen = set(fixed)
    more = [c for c in dict.fromkeys(loose(text)) if c not in seen]
    return [(*c, i < len(fixed), votes(text, *c, i < len(fixed))) for i, c in enumerate(fixed + more)]


SPAN = "struct<kind: int, start: int, end: int, base: boolean, pattern: int>"
ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))


def voted(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(_row, _spans): the carried columns and the candidates of each text, as a written table."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base", "pattern"), c)) for c in candidates(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW)], ["_row", "_spans"])

    rows = docs.select(carried(docs, columns), "text")
    return written(rows.mapInArrow(of, f"_row {rows.schema[0].dataType.simpleString()}, _spans array<{SPAN}>"))


#: What the prior expects of a labeler, by class: shares of abstaining, no and yes; a failed checksum hardly ever goes with a true span.
EXPECTED = np.array([[[0.3, 0.5, 0.2], [0.3, 0.1, 0.6]]] * len(LABELERS)).transpose(1, 0, 2)
EXPECTED[:, LABELERS.index("checksum")] = [[0.2, 0.6, 0.2], [0.02, 0.003, 0.977]]


def reliabilities(given: np.ndarray, n: np.ndarray, rounds: int = 200, strength: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, probability of each vote by class and labeler, share of the classes) by EM over counted patterns.

    given: (patterns, labelers) of votes. The prior says that labelers are right more often than wrong; it counts as `strength` spans.
    """
    one = np.eye(3)[given]  # patterns, labelers, votes
    first = np.einsum("plv,clv->cp", one, np.log(EXPECTED))
    p = 1 / (1 + np.exp(first[0] - first[1]))
    for _ in range(rounds):
        w = np.stack([(1 - p) * n, p * n])
        share = (w.sum(1) + strength) / (w.sum() + 2 * strength)
        theta = np.einsum("cp,plv->clv", w, one) + strength * EXPECTED
        theta /= theta.sum(2, keepdims=True)
        like = np.log(share)[:, None] + np.einsum("plv,clv->cp", one, np.log(theta))
        after = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
        moved, p = np.abs(after - p).max(), after
        if moved < 1e-9:
            break
    return p, theta, share


def features(given: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(given), 1)), given == YES, given == NO, shape], axis=1).astype(float)


def classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method over counted patterns."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (q - p)) + penalty * w
        step = np.linalg.solve((x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w)), slope)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def learned(counts: dict[int, int]) -> dict[int, float]:
    """The final classifier's probability of each counted pattern."""
    out = {}
    codes = sorted(counts)
    parts = [decoded(c) for c in codes]
    for kind in range(len(KINDS)):
        mine = [i for i, part in enumerate(parts) if part[0] == kind]
        if mine:
            given, shape = np.array([parts[i][1] for i in mine]), np.array([parts[i][2] for i in mine])
            n = np.array([counts[codes[i]] for i in mine], dtype=float)
            p, _, _ = reliabilities(given, n)
            x = features(given, shape)
            q = 1 / (1 + np.exp(-np.clip(x @ classifier(x, p, n), -30, 30)))
            out |= {codes[i]: float(v) for i, v in zip(mine, q)}
    return out


def chosen(spans: list[dict], model: dict[int, float], least: float = LEAST) -> list[tuple[int, int, int, bool, float]]:
    """(kind, start, end, base, probability): base spans, and likely others that overlap none of their kind; by kind and start."""
    kept: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    out = []
    likely = [(model.get(s["pattern"], 0.0), s) for s in spans]
    for p, s in sorted(likely, key=lambda x: (not x[1]["base"], -x[0], x[1]["start"] - x[1]["end"], x[1]["start"])):
        mine, a, b = kept[s["kind"]], s["start"], s["end"]
        if not s["base"] and p < least:
            continue
        i = bisect_left(mine, (a, b))
        if not s["base"] and (i and mine[i - 1][1] > a or i < len(mine) and mine[i][0] < b):
            continue
        mine.insert(i, (a, b))
        out.append((s["kind"], a, b, s["base"], 1.0 if s["base"] else p))
    return sorted(out)


def found(docs: DataFrame, columns: Sequence[str] | None = None, least: float = LEAST) -> DataFrame:
    """Every document with spans: array<struct<kind: string, start, end, base, score>>, by kind and start.

    The classifier learns from all documents' candidates; only counts of patterns come to the driver.
    """
    columns = list(columns or docs.columns)
    rows = voted(docs, columns)
    counts = rows.select(F.explode("_spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    model = learned({r.pattern: r.n for r in counts.collect()})  # patterns are of a fixed number
    names = ("kind", "start", "end", "base", "score")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(names, (KINDS[c[0]], *c[1:]))) for c in chosen(s.as_py() or [], model, least)] for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, arrow)], ["_row", "_found"])

    kind = f"_row {rows.schema['_row'].dataType.simpleString()}, _found array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"
    return unpacked(rows.mapInArrow(of, kind), columns, spans=F.col("_found"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans are one, of the earliest one's kind."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                text, parts, at = text.as_py(), [], 0
                for s in sorted(spans.as_py(), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                out.append(text if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "_text"])

    rows = found(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), "text"), least=least)
    kind = rows.schema["_doc"].dataType.simpleString()
    clean = rows.select("_doc", "text", "spans").mapInArrow(of, f"_row {kind}, _text string")
    return unpacked(clean, [c for c in docs.columns], text=F.col("_text")).select(*docs.columns)
