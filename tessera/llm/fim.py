"""Fill in the middle: texts cut at two unit boundaries and rearranged around sentinels.

A byte automaton, driven by one table, reads the UTF-8 of a text: continuation bytes stay inside their character, a
change from a word to a gap ends a unit, and a trie with failure links follows the sentinels. The first scan runs block
by block and counts the transitions of each block: unit ends, characters, sentinels. The second looks up from those
counts in which blocks the cuts lie, and reads only these again. The state after a byte depends on no more bytes
than the longest sentinel has, so all positions of a block run at once, that many table lookups each.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.common import map_arrow, table

#: Marks of prefix, suffix and middle; none may overlap another or itself.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = "42"
#: Percent of the texts that are rearranged, and of those the percent that begins with the suffix.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of a block of the scan.
BLOCK = 1 << 18
GAPS = b" \t\n\x0b\x0c\r"
UNIT_END, CHARACTER, SENTINEL = 1, 2, 4


class Automaton:
    """``step[state, byte class]`` and what each such transition marks; a state is (trie node, inside a word)."""

    def __init__(self, sentinels: tuple[str, ...]):
        import numpy as np

        marks = [s.encode() for s in sentinels]
        if not all(marks) or any(set(m) & set(GAPS) or max(m) > 127 for m in marks):
            raise ValueError("a sentinel is one or more ASCII characters without gaps")
        letters = sorted(set(b"".join(marks)))
        #: Byte to class: 0 a gap, 1 a continuation byte, 2 any other character, then one for each byte of the sentinels.
        self.classes = bytes(0 if b in GAPS else 3 + letters.index(b) if b in letters else 1 if 128 <= b < 192 else 2 for b in range(256))
        nodes = sorted({m[:i] for m in marks for i in range(len(m) + 1)})
        number = {node: i for i, node in enumerate(nodes)}
        self.n_classes, self.memory = 3 + len(letters), max(map(len, marks))
        step = np.zeros((2 * len(nodes), self.n_classes), np.intp)
        emits = np.zeros_like(step)
        for node, at in number.items():
            for word in (0, 1):
                for c in range(self.n_classes):
                    seen = node + bytes([letters[c - 3]]) if c >= 3 else b""
                    longest = next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in number)
                    step[2 * at + word, c] = 2 * number[longest] + (c != 0)
                    emits[2 * at + word, c] = UNIT_END * (word and c == 0) + CHARACTER * (c != 1) + SENTINEL * (longest in marks)
        self.start = 2 * number[b""]
        self.step, self.emits = step.ravel(), emits.ravel()

    def transitions(self, data, at: int, end: int):
        """Number of the transition (state times classes plus class) that each byte from ``at`` to ``end`` makes."""
        import numpy as np

        m = self.memory
        begin = max(0, at - m)
        seen = np.frombuffer(bytes(data[begin:end]).translate(self.classes), np.uint8).astype(np.intp)
        first = at - begin
        state = np.full(end - at, self.start, np.intp)
        for back in range(m, 0, -1):  # bytes before the text are as none: there the state stays that of the start
            lead = max(0, back - first)
            if lead < len(state):
                state[lead:] = self.step[state[lead:] * self.n_classes + seen[first - back + lead : len(seen) - back]]
        return state * self.n_classes + seen[first:]


@functools.lru_cache(maxsize=8)
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(sentinels)


class Scan:
    """The first scan of a text: counts of transitions by block."""

    def __init__(self, data, dfa: Automaton):
        import numpy as np

        self.data, self.dfa = data, dfa
        marks = [dfa.emits & bit != 0 for bit in (UNIT_END, CHARACTER, SENTINEL)]
        counts = [[0, 0, 0]]
        for at in range(0, len(data), BLOCK):
            made = np.bincount(dfa.transitions(data, at, min(at + BLOCK, len(data))), minlength=len(dfa.emits))
            counts.append([int(made[m].sum()) for m in marks])
        #: Unit ends and characters before each block, and the sentinels of the text.
        self.ends, self.characters, sentinels = np.cumsum(counts, axis=0).T
        self.n_units = int(self.ends[-1]) + 1 if len(data) else 0
        self.has_sentinel = bool(sentinels[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, characters) of the first ``units`` units: the second pass, over one block."""
        import numpy as np

        if units <= 0:
            return 0, 0
        if units >= self.n_units:
            return len(self.data), int(self.characters[-1])
        block = int(np.searchsorted(self.ends, units)) - 1
        at = block * BLOCK
        made = self.dfa.emits[self.dfa.transitions(self.data, at, min(at + BLOCK, len(self.data)))]
        byte = int(np.flatnonzero(made & UNIT_END)[units - int(self.ends[block]) - 1])
        return at + byte, int(self.characters[block]) + int(np.count_nonzero(made[:byte] & CHARACTER))


def draws(doc_id, seed: str) -> list[int]:
    """Four numbers below 2**32 from the id; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id, data, dfa: Automaton, sentinels, seed: str, rate: int, suffix_first: int):
    """(output bytes, form, units, prefix characters, middle characters) of a text."""
    scan = Scan(data, dfa)
    n = scan.n_units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or scan.has_sentinel or h3 % 100 >= rate:
        return data, "plain", n, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, upto) = scan.cut(low), scan.cut(high)
    p, s, m = (x.encode() for x in sentinels)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < suffix_first:
        return b"".join((s, suffix, p, prefix, m, middle)), "spm", n, before, upto - before
    return b"".join((p, prefix, s, suffix, m, middle)), "psm", n, before, upto - before


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with fim (the output text), fim_form (plain, psm or spm), fim_units, fim_prefix_chars and fim_middle_chars.

    Cuts and form follow from seed and id alone, so reruns and repeated rows agree. Null or empty text: plain, empty
    output, no units. A text that holds a sentinel stays plain. A null id draws as an empty one. Very long texts are
    scanned in blocks; an empty table gives no rows. Columns of the added names are replaced, all others stay.
    """
    added = [StructField("fim", StringType()), StructField("fim_form", StringType()), *(StructField(c, LongType()) for c in ("fim_units", "fim_prefix_chars", "fim_middle_chars"))]
    own = docs.drop(*(f.name for f in added))
    id_at, text_at = own.columns.index(id_col), own.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        dfa = automaton(tuple(sentinels))
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            made = [rearranged(i, t or b"", dfa, sentinels, seed, rate, suffix_first) for i, t in zip(batch.column(id_at).to_pylist(), (t.as_py() for t in texts))]
            out = [pa.array([m[0] for m in made], pa.binary()).cast(pa.string()), pa.array([m[1] for m in made], pa.string()), *(pa.array([m[k] for m in made], pa.int64()) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in added)])

    return map_arrow(own, run, StructType([*own.schema.fields, *added]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text behind an output: its parts put back in order."""
    quoted = "|".join("".join(f"\\x{ord(c):02x}" for c in s) for s in sentinels)
    parts = F.split(output, quoted)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fim(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim", 256).alias("output_sha256"), F.sha2(restored(F.col("fim"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


_JOINED = "coalesce(array_to_string({0}, ''), '')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
  CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high FROM t),
p AS (SELECT doc_id, text, n, {_JOINED.format('units[1:low]')} AS prefix, {_JOINED.format('units[low+1:high]')} AS middle, {_JOINED.format('units[high+1:n]')} AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
