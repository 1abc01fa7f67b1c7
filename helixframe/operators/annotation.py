"""Features of sequences as array Columns: reading frames, introns, promoters, hydropathy, regions and motifs.

Scans that regular expressions and array functions can express are built-in Columns; window profiles of proteins are
Arrow functions that lay the sequences of a batch end to end and scan them together with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.descriptors import HYDROPATHY

#: Identifiers, names and patterns of the built-in motifs.
MOTIFS: dict[str, tuple[str, str]] = {
    "PS00001": ("N-glycosylation site", r"N[^P][ST][^P]"),
    "PS00004": ("cAMP/cGMP-dependent protein kinase phosphorylation site", r"[RK]{2}.[ST]"),
    "PS00006": ("Casein kinase II phosphorylation site", r"[ST].{2}[DE]"),
    "PS00007": ("Protein kinase C phosphorylation site", r"[ST].[RK]"),
    "PS00008": ("N-myristoylation site", r"G[^EDRKHPFYW].{2}[STAGCN][^P]"),
    "WALKER_A": ("Walker A motif (P-loop NTPase)", r"[AG].{4}GK[ST]"),
    "ZINC_FINGER_C2H2": ("C2H2-type zinc finger", r"C.{2,4}C.{3}[LIVMFYWC].{8}H.{3,5}H"),
}
TATA = "TATA[AT]A[AT]?"
SMALL, POSITIVE = "AGSCT", "KR"
MARK = "\x01"


def places(items: Column, wanted) -> Column:
    """Indexes of the elements for which `wanted` holds."""
    return F.filter(F.transform(items, lambda x, i: F.when(wanted(x), i)), lambda i: i.isNotNull())


def frame_orfs(sequence: Column, strand: int, frame: int, least: int) -> Column:
    """Open frames of one strand and frame: the first ATG opens, the next stop closes.

    Codons are written as letters (M opens, * stops), where open frames are the matches of one pattern: their first
    letters are marked to give the places, and the texts give the lengths.
    """

    def found(c: Column) -> Column:
        letters = F.array_join(F.transform(c, lambda x: F.when(x == "ATG", "M").when(x.isin(*S.STOPS), "*").otherwise(".")), "")
        return S.let(letters, lambda t: F.filter(F.zip_with(F.regexp_extract_all(t, F.lit(r"(M[^*]*)\*"), F.lit(1)), places(S.symbols(F.regexp_replace(t, r"M([^*]*\*)", "S$1")), lambda x: x == "S"), lambda text, first: hit(c, F.char_length(text), first)), lambda h: h["protein_length"] >= least))

    def hit(c: Column, size: Column, first: Column) -> Column:
        whole = F.array_join(F.transform(F.slice(c, first + 1, size), lambda x: S.lookup(S.CODONS, x, "X")), "")
        return F.struct(
            (first * 3 + frame).cast("long").alias("start"), ((first + size) * 3 + 3 + frame).cast("long").alias("end"), F.lit(strand).alias("strand"), F.lit(frame).alias("frame"),
            size.cast("long").alias("protein_length"), F.when(size >= least, whole).alias("protein"),
        )

    return S.let(S.codons(F.substring(sequence, F.lit(frame + 1), F.char_length(sequence))), found)


def orfs(sequence: Column, min_protein_length: int = 30, both_strands: bool = True) -> Column:
    """(start, end, strand, frame, protein_length, protein), longest first, then by start, strand and frame.

    Coordinates are 0-based on the strand's own sequence; the end takes in the stop codon.
    """
    forward = F.translate(F.upper(sequence), "U", "T")
    strands = [(1, forward)] + ([(-1, S.reverse_complement(forward))] if both_strands else [])
    hits = F.flatten(F.array(*[frame_orfs(seq, strand, frame, min_protein_length) for strand, seq in strands for frame in range(3)]))
    keyed = F.transform(hits, lambda h: F.struct((-h["protein_length"]).alias("a"), h["start"].alias("b"), (-h["strand"]).alias("c"), h["frame"].alias("d"), h.alias("h")))
    return F.transform(F.array_sort(keyed), lambda k: k["h"])


def introns(sequence: Column, min_length: int = 20, max_length: int = 5000) -> Column:
    """(start, end, length): for each GT, the first AG that ends an intron of at least `min_length` and lies inside `max_length`."""

    def scan(seq: Column) -> Column:
        size = F.char_length(seq)

        def one(start: Column) -> Column:
            last = F.least(size, start + max_length)
            at = F.call_function("locate", F.lit("AG"), seq, start + (min_length - 1))
            fits = (start + min_length < last) & (at > 0) & (at + 1 <= last)
            return F.when(fits, F.struct(start.cast("long").alias("start"), (at + 1).cast("long").alias("end"), (at + 1 - start).cast("long").alias("length")))

        return F.filter(F.transform(places(S.kmers(seq, 2), lambda x: x == "GT"), one), lambda h: h.isNotNull())

    return S.let(F.translate(F.upper(sequence), "U", "T"), scan)


def matches(text: Column, pattern: str) -> Column:
    """(start, match) of the leftmost, non-overlapping matches in a text; each is marked, and the marks before one are no letters."""
    marked = F.regexp_replace(text, f"({pattern})", f"{MARK}$1")
    starts = F.transform(places(S.symbols(marked), lambda x: x == MARK), lambda p, i: p - i)
    texts = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.zip_with(starts, texts, lambda s, m: F.struct(s.alias("start"), m.alias("match")))


def tata_boxes(sequence: Column, search_window: int = 100) -> Column:
    """(start, offset_from_end, matched_text) of TATA boxes in the last `search_window` letters."""

    def scan(seq: Column) -> Column:
        size = F.char_length(seq)
        first = F.greatest(size - search_window, F.lit(0))
        found = matches(F.substring(seq, first + 1, size), TATA)
        return F.transform(found, lambda m: F.struct((m["start"] + first).cast("long").alias("start"), (m["start"] + first - size).cast("long").alias("offset_from_end"), m["match"].alias("matched_text")))

    return S.let(F.translate(F.upper(sequence), "U", "T"), scan)


def motif_catalogue(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("pattern_id"), F.lit(n).alias("name")) for i, (n, _) in MOTIFS.items()])).alias("m")).select("m.*")


#: Hydropathy in tenths, by letter; unknown ones count 0.
_TENTHS = np.zeros(256, dtype=np.int64)
for _letter, _value in HYDROPATHY.items():
    _TENTHS[ord(_letter)] = round(_value * 10)
#: Letters of a batch that are scanned together; a longer sequence goes alone.
SLICE = 1 << 19
REGIONS = "array<struct<start:int,end:int,score:double>>"
FOUND = "array<struct<start:bigint,pattern_id:string,end:bigint,matched_text:string>>"


class Row:
    """The sequences of a batch laid end to end, upper-cased, each followed by one empty place."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.codes = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.size = np.array([len(t) for t in texts])
        self.start = np.cumsum(self.size + 1) - self.size - 1
        owner = np.repeat(np.arange(self.n), self.size + 1)
        #: For each place where its sequence begins and ends.
        self.first, self.last = self.start[owner], (self.start + self.size)[owner]
        self.place = np.arange(len(self.codes))
        self.inside = self.place < self.last

    def means(self, window: int) -> np.ndarray:
        """Mean hydropathy of centred windows, cut off at the ends of a sequence."""
        total = np.concatenate([[0], np.cumsum(_TENTHS[self.codes])])
        low, high = np.maximum(self.place - window // 2, self.first), np.minimum(self.place + window // 2 + 1, self.last)
        return (total[high] - total[low]) / (10.0 * np.maximum(high - low, 1))

    def starts_window(self, window: int) -> np.ndarray:
        """Whether a window that begins here lies in one sequence."""
        return self.place + window <= self.last

    def regions(self, begin: np.ndarray, end: np.ndarray, score: np.ndarray) -> pa.Array:
        """Regions as lists of structs, one list a sequence."""
        owner = np.searchsorted(self.start, begin, "right") - 1
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=self.n))])
        own = [pa.array((x - self.start[owner]).astype(np.int32)) for x in (begin, end)]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([*own, pa.array(score.astype(np.float64))], ["start", "end", "score"]))


def rows_of(texts: pa.Array) -> Iterator[Row]:
    """The batch in slices of about `SLICE` letters; null is empty, and a letter outside ASCII is a question mark."""
    plain = pc.replace_substring_regex(pc.ascii_upper(pc.fill_null(texts, "")), r"[^\x00-\x7F]", "?").cast(pa.binary()).to_pylist()
    held, total = [], 0
    for t in plain:
        if held and total + len(t) > SLICE:
            yield Row(held)
            held, total = [], 0
        held.append(t)
        total += len(t) + 1
    if held:
        yield Row(held)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over runs that do not touch."""
    return np.add.reduceat(values, np.stack([begin, end], axis=1).ravel())[::2] if len(begin) else np.zeros(0)


def tm_regions_of(row: Row, window: int, threshold: float, least: int = 6) -> pa.Array:
    profile = row.means(window)
    begin, end = runs((profile >= threshold) & row.inside)
    long = end - begin >= least
    begin, end = begin[long], end[long]
    return row.regions(begin, end, sums(profile, begin, end) / np.maximum(end - begin, 1))


def coiled_coils_of(row: Row, window: int, threshold: float) -> pa.Array:
    """The best of seven phases of a heptad: the mean of its core places less that of the others, written at the window's middle.

    Tenths are added up as integers and divided once, so scores at the threshold do not hang on rounding.
    """
    values, places_ = _TENTHS[row.codes], np.arange(window)
    scores = np.zeros(len(values))
    if len(values) >= window:
        best = np.full(len(values) - window + 1, -np.inf)
        for phase in range(7):
            core = np.isin((places_ - phase) % 7, (0, 3))
            n_core, n_other = core.sum(), (~core).sum()
            best = np.maximum(best, np.correlate(values, np.where(core, n_other, -n_core), "valid") / (10.0 * n_core * n_other))
        scores[window // 2 : window // 2 + len(best)] = np.where(row.starts_window(window)[: len(best)], np.maximum(best, 0.0), 0.0)
    begin, end = runs((scores >= threshold) & row.inside)
    most = np.maximum.reduceat(scores, np.stack([begin, end], axis=1).ravel())[::2] if len(begin) else np.zeros(0)
    return row.regions(begin, end, most)


def low_complexity_of(row: Row, window: int, threshold: float) -> pa.Array:
    """Runs of windows of low entropy, with the entropy of all that they cover."""
    ok = row.starts_window(window)
    part = np.arange(window + 1) / window
    term = part * np.log2(np.maximum(part, 1e-300))
    h, counted = np.zeros(len(ok)), []
    for letter in np.flatnonzero(np.bincount(row.codes)[1:]) + 1:
        total = np.concatenate([[0], np.cumsum(row.codes == letter, dtype=np.int32)])
        counted.append(total)
        h[: len(h) - window + 1] -= term[total[window:] - total[:-window]] if len(h) >= window else 0.0
    begin, last = runs(ok & (h < threshold - 1e-12))
    end = last + window - 1
    entropy = np.zeros(len(begin))
    for total in counted:
        share = (total[end] - total[begin]) / np.maximum(end - begin, 1)
        entropy -= share * np.log2(np.maximum(share, 1e-300))
    return row.regions(begin, end, entropy)


def letters_of(pattern: str) -> list[list[np.ndarray]]:
    """The lengths that a motif can have, longer repeats first as in a greedy search, each as a table of letters a place."""
    out = [[]]
    for letters, low, high in re.findall(r"(\[[^\]]+\]|[.A-Z])(?:\{(\d+)(?:,(\d+))?\})?", pattern):
        given = np.isin(np.arange(256), np.frombuffer(letters.strip("[^]").encode(), np.uint8))
        table = ~np.isin(np.arange(256), (10, 13)) if letters == "." else ~given if letters.startswith("[^") else given
        times = range(int(high or low or 1), int(low or 1) - 1, -1)
        out = [before + [table] * n for before in out for n in times]
    return out


def motifs_of(row: Row, chosen: list[str]) -> pa.Array:
    begin, order, size = [], [], []
    for i, name in enumerate(chosen):
        free = row.inside.copy()
        for tables in letters_of(MOTIFS[name][1]):
            at = np.flatnonzero(free & row.starts_window(len(tables)))
            for j, table in enumerate(tables):
                at = at[table[row.codes[at + j]]]
            free[at] = False
            begin.append(at)
            order.append(np.full(len(at), i))
            size.append(np.full(len(at), len(tables)))
    begin, order, size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begin, order, size))
    rank = np.lexsort((order, begin))
    begin, order, size = begin[rank], order[rank], size[rank]
    owner = np.searchsorted(row.start, begin, "right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=row.n))]).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(size)])
    letters = row.codes[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    texts = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
    start = begin - row.start[owner]
    found = pa.StructArray.from_arrays([pa.array(start), pa.array(chosen, pa.string()).take(pa.array(order)), pa.array(start + size), texts], ["start", "pattern_id", "end", "matched_text"])
    return pa.ListArray.from_arrays(pa.array(offsets), found)


def _regions(helper, *args, kind: str = REGIONS):
    @F.arrow_udf(kind)
    def scan(sequence: pa.Array) -> pa.Array:
        return pa.concat_arrays([helper(row, *args) for row in rows_of(sequence)])

    return scan


def tm_regions(sequence: Column, window: int = 19, threshold: float = 1.6) -> Column:
    return _regions(tm_regions_of, window, threshold)(sequence)


def coiled_coils(sequence: Column, window: int = 28, threshold: float = 1.0) -> Column:
    return _regions(coiled_coils_of, window, threshold)(sequence)


def low_complexity(sequence: Column, window: int = 12, threshold: float = 3.0) -> Column:
    return _regions(low_complexity_of, window, threshold)(sequence)


def motifs(sequence: Column, ids: list[str] | None = None) -> Column:
    """(start, pattern_id, end, matched_text) of the motifs, overlapping ones too, by start, then in the order of the patterns.

    Null stays null; a letter outside ASCII is shown as a question mark.
    """
    chosen = list(ids or MOTIFS)
    for i in chosen:
        if i not in MOTIFS:
            raise ValueError(f"unknown motif {i!r}; known are {', '.join(MOTIFS)}")
    return F.when(sequence.isNotNull(), _regions(motifs_of, chosen, kind=FOUND)(sequence))


def hydropathy(sequence: Column, window: int = 19) -> Column:
    """The windowed mean at every residue."""

    @F.arrow_udf("array<double>")
    def profile(s: pa.Array) -> pa.Array:
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(row.size)]).astype(np.int32)), pa.array(row.means(window)[row.inside])) for row in rows_of(s)]
        return pa.concat_arrays(lists)

    return profile(sequence)


def hydrophobic_cores(profile: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and mean of each row's best core, -1 and 0 without one.

    Where the profile stays at 1.0 or more, a core is what follows the first 1.5 there; it has 6 to 20 places.
    """
    padded = np.pad(profile, ((0, 0), (0, 1)), constant_values=-np.inf)
    flat = padded.ravel()
    begin, end = runs(flat >= 1.0)
    high = np.append(np.flatnonzero(flat >= 1.5), len(flat))
    begin = high[np.searchsorted(high, begin)]
    fits = (end - begin >= 6) & (end - begin <= 20)
    begin, end = begin[fits], end[fits]
    mean, row = sums(flat, begin, end) / np.maximum(end - begin, 1), begin // (size + 1)
    core, best = np.full(len(profile), -1), np.zeros(len(profile))
    for i in np.lexsort((-begin, mean)):  # the best mean of a row is written last, the first of ties
        core[row[i]], best[row[i]] = begin[i] % (size + 1), mean[i]
    return core, best


def signal_peptide(sequence: Column, max_length: int = 30) -> Column:
    """A positive start, a hydrophobic core and small residues two apart after it, within the first `max_length` residues."""
    width = max_length + 5

    def judge(row: Row) -> pa.Array:
        letters = np.zeros((row.n, width), dtype=np.uint8)
        held = np.minimum(row.size, width)
        own = np.repeat(np.arange(row.n), held)
        column = np.arange(len(own)) - np.repeat(np.cumsum(held) - held, held)
        letters[own, column] = row.codes[row.start[own] + column]
        total = np.concatenate([np.zeros((row.n, 1), np.int64), np.cumsum(_TENTHS[letters], axis=1)], axis=1)
        at = np.arange(width)[None, :]
        low, high = np.maximum(at - 3, 0), np.minimum(at + 4, held[:, None])
        inside = at < held[:, None]
        spread = np.take_along_axis(total, np.maximum(high, 0), axis=1) - np.take_along_axis(total, np.broadcast_to(low, letters.shape), axis=1)
        profile = np.where(inside, spread / (10.0 * np.maximum(high - low, 1)), -np.inf)
        core, best = hydrophobic_cores(profile, width)
        small = np.isin(letters, np.frombuffer(SMALL.encode(), np.uint8))
        sites = np.zeros_like(small)
        sites[:, :-2] = small[:, :-2] & small[:, 2:]
        sites &= (at >= core[:, None] + 6) & (at < np.minimum(row.size - 1, max_length)[:, None]) & (core >= 0)[:, None]
        cleft = sites.any(axis=1)
        positive = np.isin(letters[:, :5], np.frombuffer(POSITIVE.encode(), np.uint8)).any(axis=1)
        score = np.where(core >= 0, np.round(np.minimum(0.3 * positive + np.minimum(best / 4, 0.4) + 0.3 * cleft, 1.0), 3), 0.0)
        site = pa.array((sites.argmax(axis=1) + 3).astype(np.int32), mask=~cleft)
        return pa.StructArray.from_arrays([pa.array(positive & (best >= 1.5) & cleft), site, pa.array(score)], ["is_signal_peptide", "cleavage_site", "score"])

    @F.arrow_udf("is_signal_peptide boolean, cleavage_site int, score double")
    def predict(s: pa.Array) -> pa.Array:
        return pa.concat_arrays([judge(row) for row in rows_of(s)])

    return predict(sequence)


#: Tag that a record gets for each kind of feature it has.
TAGS = {"orfs": "has_orf", "introns": "has_intron_candidate", "promoter_hits": "has_tata_box", "tm_regions": "transmembrane", "coiled_coil_regions": "coiled_coil", "low_complexity_regions": "low_complexity", "interpro": "interpro_annotated"}


def annotate(df: DataFrame, **features: Column) -> DataFrame:
    """Add features as columns, named as in TAGS, `motifs` or `signal_peptide`, and the tags they earn; tags are never removed."""
    df = df.withColumns(features)
    earned = [F.when(F.size(name) > 0, F.array(F.lit(TAGS[name]))) for name in features if name in TAGS]
    if "signal_peptide" in features:
        earned.append(F.when(F.col("signal_peptide.is_signal_peptide"), F.array(F.lit("signal_peptide"))))
    if "motifs" in features:
        earned.append(F.transform("motifs", lambda m: F.concat(F.lit("motif:"), m["pattern_id"])))
    none = F.array().cast("array<string>")
    for tags in earned:
        df = df.withColumn("tags", F.array_sort(F.array_union("tags", F.coalesce(tags, none))))
    return df
