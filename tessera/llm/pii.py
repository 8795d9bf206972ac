"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digit pairs that only an address, a card or a
phone number can hold, and words that announce an identifier, in whatever case. Deterministic parsers then expand each anchor to the
boundaries of the email, address or account it belongs to and validate it. Every parser moves forward only, so a text
costs time linear in its length, whatever it holds.

Kinds: the base ones ``email``, ``ip``, ``card``, ``phone`` in the order listed, leftmost and non-overlapping within a
kind; the method adds ``url`` (after a scheme), ``account`` (after a cue, letters and digits with at least 4 digits)
and ``secret`` (after a cue, 16 characters or more with letters and digits). Offsets are code points, end exclusive.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
#: Schemes and cues, lower case.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "tax id", "customer no", "member id", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api key", "access key")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")
SECRET = LETTERS | DIGITS | frozenset("-_+/=.")


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    d = sorted(DIGITS)
    words = {"@": "email"} | {s: "url" for s in SCHEMES}
    words |= {x + "." + y: "ip" for x in d for y in d} | {"+" + x: "phone" for x in d}
    words |= {x + gap + y: "card" for x in d for gap in ("", " ", "-") for y in d}
    words |= {c: "account" for c in ACCOUNT_CUES} | {c: "secret" for c in SECRET_CUES}
    for w, kind in words.items():
        a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def folded(t: str) -> str:
    """The text in lower case, character by character, so that places stay the same."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c if len(x := c.lower()) != 1 else x for c in t)


def email_at(t: str, at: int, low: int) -> tuple[int, int] | None:
    """The address around the at-sign, not beginning before ``low``."""
    i, n = at, len(t)
    while i > low and t[i - 1] in LOCAL:
        i -= 1
    if i == at:
        return None
    j = at + 1
    while j < n and t[j] in LABEL:
        j += 1
    if j == at + 1:
        return None
    end = None
    while j + 1 < n and t[j] == "." and t[j + 1] in LABEL:
        j += 1
        while j < n and t[j] in LABEL:
            j += 1
        end = j
    return (i, end) if end else None


def digit_run(t: str, i: int, low: int) -> int:
    """Start of the run of digits that ends at ``i``."""
    while i > low and t[i - 1] in DIGITS:
        i -= 1
    return i


def ips_at(t: str, i: int, low: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of dotted digit runs that begins with the run holding ``i``; the end of the chain."""
    n, start = len(t), digit_run(t, i, low)
    runs = []
    while True:
        j = start
        while j < n and t[j] in DIGITS:
            j += 1
        runs.append((start, j))
        if j + 1 < n and t[j] == "." and t[j + 1] in DIGITS:
            start = j + 1
        else:
            break
    found = []
    for k in range(0, len(runs) - 3, 4):
        parts = [t[a:b].lstrip("0") for a, b in runs[k : k + 4]]
        if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
            found.append((runs[k][0], runs[k + 3][1]))
    return found, runs[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def card_at(t: str, i: int, low: int) -> tuple[tuple[int, int] | None, int]:
    """The chain of digits with single separators around ``i``, if it is a card number; the end of the chain."""
    n = len(t)
    while i > low:
        if t[i - 1] in DIGITS:
            i -= 1
        elif i - 1 > low and t[i - 1] in " -" and t[i - 2] in DIGITS:
            i -= 2
        else:
            break
    j, digits = i + 1, [t[i]]
    while j < n:
        if t[j] in DIGITS:
            digits.append(t[j])
            j += 1
        elif t[j] in " -" and j + 1 < n and t[j + 1] in DIGITS:
            digits.append(t[j + 1])
            j += 2
        else:
            break
    return ((i, j) if 13 <= len(digits) <= 19 and luhn("".join(digits)) else None), j


def phone_at(t: str, i: int) -> tuple[tuple[int, int] | None, int]:
    """The number that begins with the plus at ``i``; where to go on."""
    n, j = len(t), i + 2
    while j < n and t[j] in PHONE:
        j += 1
    end = j
    while end > i + 3 and t[end - 1] not in DIGITS:
        end -= 1
    if end <= i + 3 or t[end - 1] not in DIGITS:
        return None, j
    return ((i, end) if 9 <= sum(c in DIGITS for c in t[i:end]) <= 15 else None), end


def url_at(t: str, i: int, after: int) -> tuple[int, int] | None:
    n, j = len(t), after
    while j < n and t[j] not in URL_END:
        j += 1
    while j > after and t[j - 1] in ".,;:!?)]":
        j -= 1
    return (i, j) if j > after else None


def value_at(t: str, after: int) -> tuple[int, int]:
    """The value that a cue announces: behind at most 12 of ``=:"'#`` blanks and the words no, number, id, is."""
    n, j = len(t), after
    while j < n and j - after < 12 and t[j] in " \t=:\"'#.":
        j += 1
    for w in ("number", "no", "nr", "id", "is"):
        if t[j : j + len(w)].lower() == w and j + len(w) < n and t[j + len(w)] not in LETTERS:
            j += len(w)
            top = j + 6
            while j < n and j < top and t[j] in " \t=:\"'#.":
                j += 1
            break
    k = j
    while k < n and t[k] in SECRET:
        k += 1
    return j, k


def account_at(t: str, after: int) -> tuple[int, int] | None:
    """Letters and digits in groups of at most one blank or hyphen, 6 to 34 of them, at least 4 digits, the last group with a digit."""
    i, _ = value_at(t, after)
    n, j, chars, digits, end = len(t), i, 0, 0, i
    while j < n:
        k = j
        while k < n and (t[k] in DIGITS or t[k] in LETTERS):
            k += 1
        if k == j or not any(c in DIGITS for c in t[j : min(k, j + 35)]):
            break
        chars, digits, end = chars + k - j, digits + sum(c in DIGITS for c in t[j : min(k, j + 35)]), k
        if chars > 34 or not (k < n and t[k] in " -"):
            break
        j = k + 1
    return (i, end) if 6 <= chars <= 34 and digits >= 4 else None


def secret_at(t: str, after: int) -> tuple[int, int] | None:
    i, j = value_at(t, after)
    while j > i and t[j - 1] in ".=-":
        j -= 1
    s = t[i:j]
    return (i, j) if j - i >= 16 and any(c in DIGITS for c in s) and any(c in LETTERS for c in s) else None


def find(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, ascending; those of a kind do not overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # the parser of a kind has dealt with all before
    for last, (kind, size) in automaton().iter(folded(t)):
        first = last - size + 1
        low = done[kind]
        if kind == "email":
            if first >= low and (span := email_at(t, first, low)):
                out[kind].append(span)
                done[kind] = span[1]
        elif kind == "card":
            if first >= low:
                span, done[kind] = card_at(t, first, low)
                if span:
                    out[kind].append(span)
        elif kind == "ip":
            if first >= low:
                spans, done[kind] = ips_at(t, first, low)
                out[kind] += spans
        elif kind == "phone":
            if first >= low:
                span, done[kind] = phone_at(t, first)
                if span:
                    out[kind].append(span)
        elif first >= low:
            edge = first == 0 or not (t[first - 1] in LETTERS or t[first - 1] in DIGITS)
            span = None
            if edge:
                span = url_at(t, first, last + 1) if kind == "url" else account_at(t, last + 1) if kind == "account" else secret_at(t, last + 1)
            if span and span[0] >= low:
                out[kind].append(span)
                done[kind] = span[1]
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(t: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become the one that begins first, the longest of those."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [t[at:a], f"[{k.upper()}]"]
        if b > at:
            at = b
    return "".join([*out, t[at:]])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted): one row a row of ``docs``.

    The counts and the digest are of the base spans; spans lists all. Null text: as empty, no spans, redacted null.
    Rows are independent, so repeated rows give repeated results and an empty table none; other columns are dropped.
    """
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _spans(True), "doc_id long, " + SCHEMA)


def _spans(keep: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, shas, all_spans, texts = ([], [], [], []), [], [], []
            for x in batch.column(1):
                text = x.as_py()
                spans = find(text or "")
                for c, k in zip(counts, BASE):
                    c.append(len(spans[k]))
                shas.append(hashlib.sha256(joined(spans, BASE).encode()).hexdigest())
                all_spans.append(joined(spans))
                if keep:
                    texts.append(text if text is None else redact(text, spans))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(all_spans, pa.string())]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            if keep:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; other columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            new = pa.array([t if t is None else redact(t, find(t)) for t in texts], pa.string())
            columns = [new if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_arrow(docs, _spans(False), "doc_id long, " + SCHEMA.removesuffix(", redacted string"))
