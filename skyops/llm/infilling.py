"""Fill-in-middle transformation over indexable skip lists.

A text is cut into units: maximal runs of A-Z, a-z, or single other code points. Each text gets a skip list over its units. The lowest lane holds
every unit with its widths (units, code points, bytes); every ``FAN``-th node of a lane is promoted to the express lane above, whose node carries the
summed widths of the nodes it passes over. A cut rank is reached by descending from the top lane, going right while the accumulated units stay
within the rank, so a cut takes FAN steps a lane, and the code-point and byte positions come out exactly. The lists of a slice of texts
(about 1 MB, a longer text alone) are numpy arrays, and both cuts of all its texts descend together; nothing is shuffled.

The cuts and the form come from the sha256 of ``seed:doc_id``, so equal doc_ids get equal draws and the result does not depend on partitioning.

Defined results: null and empty texts have no units and are plain; a text that holds a mark is plain; null doc_ids draw like an empty id; equal rows give
equal results; an empty table gives an empty table; of other columns none is read or returned. In text that is not valid UTF-8 each byte
outside 0x80-0xBF starts a code point, and bytes come back as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import slices, texts

#: fixed values: the marks before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: nodes of a lane under one node of the lane above
FAN = 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False


class SkipLists:
    """One indexable skip list for each text of a slice."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        letter, starts = _LETTER[data], _STARTS[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[off] = True
        begins = begins[:-1]
        after_letter = np.concatenate([[False], letter[:-1]])[: len(data)] & ~begins
        unit = np.flatnonzero(begins | (starts & ~(letter & after_letter)))
        first = np.searchsorted(unit, off)
        ends = np.append(unit[1:], len(data)) if len(unit) else unit
        # bytes that start code points up to each place; a text's first byte counts as a start
        points = np.concatenate([[0], np.cumsum(starts | begins)])
        widths = np.stack([np.ones(len(unit), np.int64), points[ends] - points[unit], ends - unit], axis=1)
        #: per lane, lowest first: offsets of the texts' nodes, and the nodes' widths in units, code points and bytes
        self.lanes = [(first, widths)]
        self.units = np.diff(first)
        count = self.units
        while count.max(initial=0) > FAN:
            below_first, below = self.lanes[-1]
            count = -(-count // FAN)
            first = np.concatenate([[0], np.cumsum(count)])
            heads = np.repeat(below_first[:-1] - FAN * first[:-1], count) + FAN * np.arange(first[-1])
            self.lanes.append((first, np.add.reduceat(below, heads, axis=0)))

    def descend(self, rank: np.ndarray) -> np.ndarray:
        """Per text the units, code points and bytes before its unit number ``rank``."""
        passed = np.zeros((len(rank), 3), np.int64)
        node = np.zeros(len(rank), np.int64)
        for lane, (first, widths) in enumerate(reversed(self.lanes)):
            node *= FAN if lane else 1
            going = np.arange(len(rank))
            while len(going):
                at = first[going] + node[going]
                inside = at < first[going + 1]
                going, at = going[inside], at[inside]
                fits = passed[going, 0] + widths[at, 0] <= rank[going]
                going, at = going[fits], at[fits]
                passed[going] += widths[at]
                node[going] += 1
        return passed


def draws(seed: int = 1) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the sha256 of ``seed:doc_id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Rows: doc_id, n_units, form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain), output (the transformed text).
    ``percent`` of the texts without marks are transformed, ``spm_percent`` of these suffix first."""
    marks = [F.instr("text", m) > 0 for m in (PREFIX, SUFFIX, MIDDLE)]
    h = draws(seed)
    form = (F.when(F.coalesce(F.col("text"), F.lit("")).eqNullSafe("") | marks[0] | marks[1] | marks[2] | (h[2] % 100 >= percent), "plain")
            .when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    prefix, suffix, middle = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            forms = batch.column("form").to_pylist()
            for i, j, data, off in slices(batch.column("text")):
                lists, raw = SkipLists(data, off), data.tobytes()
                cuts = np.sort(np.stack([h[i:j] % (lists.units + 1) for h in (h1, h2)]), axis=0)
                one, two = lists.descend(cuts[0]), lists.descend(cuts[1])
                outputs = []
                for form, a, x, y, b in zip(forms[i:j], off[:-1].tolist(), (off[:-1] + one[:, 2]).tolist(), (off[:-1] + two[:, 2]).tolist(), off[1:].tolist(),
                                            strict=True):
                    if form == "psm":
                        outputs.append(b"".join((prefix, raw[a:x], suffix, raw[y:b], middle, raw[x:y])))
                    elif form == "spm":
                        outputs.append(b"".join((suffix, raw[y:b], prefix, raw[a:x], middle, raw[x:y])))
                    else:
                        outputs.append(raw[a:b])
                plain = np.array([f == "plain" for f in forms[i:j]], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(lists.units, pa.int64()), batch.column("form").slice(i, j - i),
                     pa.array(one[:, 1], pa.int64(), mask=plain), pa.array(two[:, 1] - one[:, 1], pa.int64(), mask=plain), pa.array(outputs, pa.binary())],
                    names=["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = texts(docs.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2")), "form", "h1", "h2")
    out = drawn.mapInArrow(run, f"doc_id {kind}, n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return out.withColumn("output", out.output.cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, from the output and its form alone."""
    body = f"substring({output}, {1 + len(PREFIX)})"  # after the first mark; marks have one length
    last = f"substring_index({output}, '{MIDDLE}', -1)"
    head = f"substring_index({body}, '{MIDDLE}', 1)"
    psm = f"concat(substring_index({head}, '{SUFFIX}', 1), {last}, substring_index({head}, '{SUFFIX}', -1))"
    spm = f"concat(substring_index({head}, '{PREFIX}', -1), {last}, substring_index({head}, '{PREFIX}', 1))"
    return F.expr(f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {output} END")
