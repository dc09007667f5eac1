"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template of P places of shingles is sought in windows that start every s places, s being the power of two with 4 s <= P < 8 s (1 for
shorter ones), and are long enough that any run of P + s places lies within one. If the run holds a share c = 0.8 of the template's
shingles, the window's Jaccard similarity to the template is at least c P / (P + 2 s + (1 - c) P), never
below 0.33. With ``BANDS`` = 24 bands of one value each, it is retrieved with a probability of 1 - (1 - 0.33)**24 > 0.9999. Minima of
windows come from minima of blocks of s places, and those from blocks half as long, so the work for a text does not grow
with the number of templates; only retrieved windows meet a template's own shingles.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEMPLATES
from .shared import bounded_batches
from .words import WordHashes, windows

SHINGLE = 5
BANDS = 24
CONTAINMENT = 0.8
#: Windows have one of these numbers of blocks, so that templates of like lengths share theirs.
WINDOW_BLOCKS = (3, 6, 8, 10)
#: Places of a text that are looked at together; a power of two.
SEGMENT = 1 << 16

_WORD = re.compile(r"\w+(?:[-.]\w+)*")
_generator = np.random.default_rng(77)
_SEEDS = _generator.integers(0, 2**32, BANDS, dtype=np.uint32)
_FACTORS = _generator.integers(0, 2**31, BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Bits of a minimum that a first look goes by.
LOOK = 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def band_values(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's 32-bit value under each band's hash, a bijection of its upper half; minima of these are MinHash values."""
    return ((shingles >> np.uint64(32)).astype(np.uint32)[:, None] ^ _SEEDS) * _FACTORS


class Template:
    """One license: its shingles, and how long the windows are that it is sought in."""

    def __init__(self, name: str, shingles: np.ndarray, width: int):
        self.name, self.width, self.places = name, width, len(shingles)
        self.shingles = np.unique(shingles)
        self.step = 1 << max(0, (self.places // 4).bit_length() - 1)
        need = -(-self.places // self.step) + 2
        self.blocks = next((b for b in WINDOW_BLOCKS if b >= need), need)
        self.reach = self.places + self.step

    def number(self, shingles: np.ndarray) -> np.ndarray:
        """Which of the template's shingles each is, or -1."""
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, at, -1)


class Group:
    """Templates that are sought in windows of one kind: for each band, which minima lead to which of them."""

    def __init__(self):
        self.found: dict[tuple[int, int], list[Template]] = {}
        self.maybe = np.zeros(1 << LOOK, bool)
        self.fewest = 1 << 62

    def add(self, template: Template, containment: float) -> None:
        for band, value in enumerate(band_values(template.shingles).min(axis=0).tolist()):
            self.found.setdefault((band, value), []).append(template)
            self.maybe[value >> 32 - LOOK] = True
        self.fewest = min(self.fewest, int(containment * len(template.shingles)))

    def retrieve(self, minima: np.ndarray):
        """(window, template) of windows that share a band with a template."""
        hits = np.flatnonzero(self.maybe.take(minima >> np.uint32(32 - LOOK)))
        seen = set()
        for at, value in zip(hits.tolist(), minima.reshape(-1)[hits].tolist()):
            w, band = divmod(at, BANDS)
            for template in self.found.get((band, value), ()):
                if (w, template.name) not in seen:
                    seen.add((w, template.name))
                    yield w, template


def _minima_of(least: np.ndarray, blocks: int) -> np.ndarray:
    """The minimum of every block and the ``blocks`` - 1 after it, fewer at the end, by doubling."""
    reach, size = least, 1
    while size < blocks:
        more = min(size, blocks - size)
        wider = reach.copy()
        np.minimum(reach[:-more], reach[more:], out=wider[:-more])
        reach, size = wider, size + more
    return reach


class Matcher:
    """Templates of any length, and the scan of one text."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        self.containment = containment
        self.memo = WordHashes()
        #: shingle width -> step -> blocks of a window -> group
        self.groups: dict[int, dict[int, dict[int, Group]]] = {}
        self.overlap = 0
        for name, text in templates.items():
            words = words_of(text)
            if not words:
                raise ValueError(f"template {name} needs a word")
            width = min(SHINGLE, len(words))
            t = Template(name, windows(self.memo.of(words), width), width)
            if t.step > SEGMENT:
                raise ValueError(f"template {name} is too long")
            self.groups.setdefault(width, {}).setdefault(t.step, {}).setdefault(t.blocks, Group()).add(t, containment)
            self.overlap = max(self.overlap, t.step * t.blocks)

    def _retrieved(self, shingles: np.ndarray, by_step: dict[int, dict[int, Group]]):
        """(first place of a window, template), segment by segment, so that a text of any length takes bounded memory."""
        n = len(shingles)
        for at in range(0, n, SEGMENT):
            least = band_values(shingles[at : at + SEGMENT + self.overlap])
            for step in (1 << k for k in range(max(by_step).bit_length())):
                if step > 1:
                    pairs = len(least) // 2
                    odd = least[2 * pairs :]
                    least = np.concatenate([np.minimum(least[0 : 2 * pairs : 2], least[1 : 2 * pairs : 2]), odd])
                by_blocks = {b: g for b, g in by_step.get(step, {}).items() if g.fewest <= n}
                own = min(len(least), SEGMENT // step)
                for blocks, group in by_blocks.items():
                    for w, template in group.retrieve(_minima_of(least, blocks)[:own]):
                        yield at + w * step, template

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, best containment, occurrences, first word, end word) of every template found.

        An occurrence starts at one of the template's shingles from which the next places hold enough of them, ends where the last new one
        is, and does not overlap the one before. The span is that of the best occurrence, the earliest among equals.
        """
        hashes = self.memo.of(words_of(text))
        found: dict[str, list] = {}
        for width, by_step in self.groups.items():
            if len(hashes) < width:
                continue
            shingles = windows(hashes, width)
            ends: dict[str, int] = {}
            for start, t in sorted(self._retrieved(shingles, by_step), key=lambda x: (x[1].name, x[0])):
                number = t.number(shingles[start : start + t.step * t.blocks])
                hits = np.flatnonzero(number >= 0)
                for first in hits[hits < t.step].tolist():
                    if start + first < ends.get(t.name, 0):
                        continue
                    near = hits[(hits >= first) & (hits < first + t.reach)]
                    if len(near) < self.containment * len(t.shingles) - 1e-9:
                        continue
                    kinds, new = np.unique(number[near], return_index=True)
                    share = len(kinds) / len(t.shingles)
                    if share < self.containment - 1e-9:
                        continue
                    end = start + int(near[new.max()]) + 1
                    ends[t.name] = end
                    best = found.setdefault(t.name, [0.0, 0, (0, 0)])
                    best[1] += 1
                    if share > best[0]:
                        best[0], best[2] = share, (start + first, end - 1 + width)
        return [(name, share, n, *span) for name, (share, n, span) in sorted(found.items())]


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, n_spans, first_word and end_word for every license found in every whole text.

    n_spans counts occurrences that do not overlap; words are numbered from 0, the end is exclusive. A template of fewer than five words is
    one shingle. Texts that are null, empty or shorter than every template give no row; very long ones are looked at
    in segments that overlap. Of equal shares the earliest span counts. Repeated rows give repeated results; a null doc_id stays
    null. An empty table gives no rows, and other columns take no part.
    """
    chosen = dict(templates if templates is not None else TEMPLATES)
    names = ["doc_id", "license", "containment", "n_spans", "first_word", "end_word"]

    def run(batches):
        matcher = Matcher(chosen, containment)
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for row in matcher.scan(text):
                    ids.append(doc)
                    rows.append(row)
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), *map(pa.array, columns, kinds)], names)

    kind = dict(documents.dtypes)["doc_id"]
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, containment double, n_spans long, first_word long, end_word long")
