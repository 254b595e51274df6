"""Hand-worked cases and properties of the operators."""

import math
import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.functions import expressions as X
from tallyspan.operators import coverage, footprint, intervals, motifs, peaks, profiles, samples, stats
from tallyspan.sources import layout, readers, sinks

READS = "sample int, chrom string, r_start long, r_end long, strand string, is_aligned boolean, is_duplicate boolean, tlen long"
WINDOWS = "name string, chrom string, w_start long, w_end long, w_strand string"


@contextmanager
def settings(spark, **wanted):
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut_read(d, strand="+", w_start=5000, size=40, chrom="chr1"):
    at = w_start + d
    return (1, chrom, at, at + size, strand, True, False, size) if strand == "+" else (1, chrom, at + 1 - size, at + 1, strand, True, False, -size)


@pytest.mark.parametrize("w_strand", ["+", "-", "."])
@pytest.mark.parametrize("strand", ["+", "-"])
@pytest.mark.parametrize("mode", ["exact", "reference"])
def test_cut_positions(spark, w_strand, strand, mode):
    ds = [-1, 0, 1, 2, 1997, 1998, 1999, 2000]
    reads = spark.createDataFrame([cut_read(d, strand) for d in ds], READS)
    windows = spark.createDataFrame([("p", "chr1", 5000, 7000, w_strand)], WINDOWS)
    found = {r["x"] + 1000 for r in coverage.cut_counts(reads, windows, mode=mode).collect()}
    if mode == "exact":
        want = {d if w_strand != "-" else 1999 - d for d in ds if 0 <= d < 2000}
    elif w_strand == "-":
        want = {1998 - d for d in ds if 0 <= d <= 1997}
    else:
        want = {d - 1 for d in ds if 2 <= d <= 1999 or (d == 2000 and strand == "-")}
    assert found == want


def test_flags_chromosomes_and_short_windows(spark):
    rows = [cut_read(10), (1, "chr1", 5010, 5050, "+", False, False, 40), (1, "chr1", 5010, 5050, "+", True, True, 40), cut_read(10, chrom="chrM"), cut_read(10, chrom="chrY")]
    windows = spark.createDataFrame([("a", "chr1", 5000, 7000, "+"), ("b", "chrM", 5000, 7000, "+"), ("c", "chr1", 5000, 6500, "+"), ("z", "chr2", 0, 2000, "+")], WINDOWS)
    reads = spark.createDataFrame(rows, READS)
    assert [(r["name"], r["n"]) for r in coverage.cut_counts(reads, windows).collect()] == [("a", 1)]
    profile = coverage.mean_profile(coverage.cut_counts(reads, windows), windows)
    got = {r["x"]: (r["average"], r["positive"], r["negative"]) for r in profile.collect()}
    assert len(got) == 2000 and got[-990] == (0.25, 0.5, 0.0) and got[0] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("width", [500, 2000, 10000])
def test_bin_width_does_not_matter(spark, width):
    rng = random.Random(4)
    reads = spark.createDataFrame([cut_read(rng.randrange(-3000, 6000), rng.choice("+-")) for _ in range(300)], READS)
    windows = spark.createDataFrame([(f"w{k}", "chr1", 4000 + 700 * k, 6000 + 700 * k, rng.choice("+-.")) for k in range(6)], WINDOWS)
    rows = sorted(map(tuple, coverage.cut_counts(reads, windows, bin_width=width).collect()))
    assert rows == sorted(map(tuple, coverage.cut_counts(reads, windows).collect())) and rows


def test_overlap_edges(spark):
    a = spark.createDataFrame([(1, "chr1", 0, 10), (2, "chr1", 0, 5000), (3, "chr2", 0, 10), (4, "chr1", 5, 5)], "id int, chrom string, a_start long, a_end long")
    b = spark.createDataFrame([("chr1", 10, 20), ("chr1", 9, 10), ("chr1", 4000, 9000), ("chr1", 4500, 4501)], "chrom string, b_start long, b_end long")
    assert {r["id"] for r in intervals.overlapping(a, b, ["id"]).collect()} == {1, 2}
    pairs = intervals.overlap_pairs(a, b).collect()
    assert len(pairs) == 5 and len(set(pairs)) == 5


def test_pileup_runs_of_overlapping_fragments(spark):
    reads = spark.createDataFrame([cut_read(100), cut_read(120), cut_read(-20)], READS)
    windows = spark.createDataFrame([("p", "chr1", 5000, 7000, "+")], WINDOWS)
    runs = coverage.pileup_runs(coverage.fragment_overlaps(reads, windows, 50))
    assert sorted((r["lo"], r["hi"], r["n"]) for r in runs.collect()) == [(0, 30, 1), (100, 120, 1), (120, 150, 2), (150, 170, 1)]


def test_flat_background_drops_the_window(spark):
    counts = spark.createDataFrame([(1, "a", "+", 0, 3), (1, "b", "+", 0, 3), (2, "a", "+", 0, 1)], "sample int, name string, strand string, x long, n long")
    assert {r["name"] for r in coverage.background_normalised(counts, 2).collect()} == {"a"}


@pytest.mark.parametrize("window", ["flat", "hanning", "hamming", "bartlett", "blackman"])
@pytest.mark.parametrize("n", [11, 12, 40])
def test_smoothing_equals_convolution(spark, window, n):
    v = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "k string, p long, v double")
    got = [r["v"] for r in profiles.smooth(rows, ["k"], "p", "v", 11, window).orderBy("p").collect()]
    w = np.ones(11) if window == "flat" else getattr(np, window)(11)
    mirrored = np.concatenate([v[10:0:-1], v, v[-1:-11:-1]])
    assert np.allclose(got, np.convolve(w / w.sum(), mirrored, "valid"))
    mid = [r["v"] for r in profiles.smooth(rows, ["k"], "p", "v", 11, window, centred=True).orderBy("p").collect()]
    assert len(mid) == n and np.allclose(mid, got[5 : 5 + n])


def test_smoothing_limits(spark):
    rows = spark.createDataFrame([("s", i, 1.0) for i in range(5)], "k string, p long, v double")
    assert profiles.smooth(rows, ["k"], "p", "v", 1).count() == 5
    with pytest.raises(Exception, match="shorter"):
        profiles.smooth(rows, ["k"], "p", "v", 11).collect()
    with pytest.raises(ValueError):
        profiles.smooth(rows, ["k"], "p", "v", 3, "square")


def test_top_fraction_with_ties_and_few_rows(spark):
    rows = [(1, "chr1", k, k + 1, k % 3, k) for k in range(50)] + [(2, "chr1", k, k + 1, 7, k) for k in range(10)]
    p = spark.createDataFrame(rows, "sample int, chrom string, p_start long, p_end long, q long, peak_id long")
    got = {(r["sample"], r["peak_id"]) for r in peaks.top_fraction(p, 25).collect()}
    want = {(1, r[5]) for r in sorted(rows[:50], key=lambda r: (-r[4], r[2]))[:12]} | {(2, 0), (2, 1)}
    assert got == want
    assert peaks.top_fraction(p.where("sample = 2"), 5).count() == 0


def test_constant_sample_has_no_correlation(spark):
    w = spark.createDataFrame([(1, k, 5) for k in range(9)] + [(2, k, k) for k in range(8)], "sample int, win long, n long")
    got = {(r["sample1"], r["sample2"]): (r["r"], r["n"]) for r in stats.pearson_pairs(w).collect()}
    assert got[(1, 2)] == (None, 8) and got[(2, 2)][0] == pytest.approx(1) and got[(1, 1)][0] is None


def test_weighted_t_equals_expanded(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 300, 200), rng.integers(1, 280, 150)
    h = spark.createDataFrame([(1, int(x)) for x in a] + [(2, int(x)) for x in b] + [(3, 9)], "sample int, length long").groupBy("sample", "length").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["sample1"], r["sample2"]): (r["t"], r["df"]) for r in stats.t_tests(h).collect()}
    pooled = (199 * a.var(ddof=1) + 149 * b.var(ddof=1)) / 348
    assert got[(1, 2)][0] == pytest.approx((a.mean() - b.mean()) / math.sqrt(pooled * (1 / 200 + 1 / 150))) and got[(1, 2)][1] == 348
    assert stats.two_sided_p(0.0, 10) == pytest.approx(1) and stats.two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)


def test_singletons_treat_nulls_as_equal(spark):
    cols = "id int, cell_line string, number_cells string, technique string, ip string, treatment string, bio_rep int, genome string, tech_rep int"
    rows = [(k, "K", "10M", "CM", "CTCF", t, 1, "g", 3) for k, t in enumerate([None, None, "x", None])]
    rows[3] = (3, "K", "10M", "CM", None, None, 1, "g", 3)
    got = {r["id"]: r["tech_rep"] for r in samples.relabel_singletons(spark.createDataFrame(rows, cols)).collect()}
    assert got == {0: 3, 1: 3, 2: 0, 3: 0}


def test_names_and_colours(spark):
    row = spark.createDataFrame([("K_10M_CM_PU1_GATA1", "x_unknown")], "a string, b string").select(
        X.factor_colour(F.col("a")), X.factor_colour(F.col("b")), X.factor_colour(F.col("b"), strict=True), X.rgb(F.lit("#534202")), X.reverse_complement(F.lit("AACGN")), X.strand(F.lit("1")), X.short_chromosome(F.lit("chr7"))
    ).first()
    assert list(row) == ["#6E022C", "#00523b", None, "83,66,2", "NCGTT", "-", "7"]


def test_motif_scores(spark):
    s = spark.createDataFrame([("short", "A" * 20), ("one", "A" * 21), ("n", "A" * 10 + "N" + "A" * 10)], "name string, seq string")
    got = {r["name"]: r["score"] for r in motifs.pwm_scores(s).collect()}
    assert set(got) == {"one", "n"} and got["n"] is None and got["one"] == pytest.approx(sum(motifs.MOTIF["A"]))


def test_footprints_tell_bound_from_unbound(spark):
    rng = np.random.default_rng(3)
    rows, sites = [], []
    shape = np.ones(100)
    shape[40:60] = 0.05
    shape[[38, 39, 60, 61]] = 6
    for k in range(160):
        bound = k < 60
        total = rng.poisson(60 if bound else 12)
        x = rng.choice(100, total, p=shape / shape.sum() if bound else None)
        rows += [(f"s{k}", int(p), int(n)) for p, n in zip(*np.unique(x, return_counts=True))]
        sites.append((f"s{k}", float(rng.normal(2 if bound else 0))))
    got = footprint.footprint_posteriors(spark.createDataFrame(rows, "name string, x long, n long"), spark.createDataFrame(sites, "name string, score double"), 100, rounds=6)
    p = {r["name"]: r["posterior"] for r in got.collect()}
    right = sum((p[f"s{k}"] > 0.5) == (k < 60) for k in range(160))
    assert right >= 155


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "sheet.csv").write_bytes(b"sampleName,cellLine,numberCells,technique,ip,treatment,e,b,t,u,g,rt,rl\r,K562,500K,CM,CTCF,,x,2,1,f,hg19,,\r,K562,10M,CM,,,x,1,1,f,hg19,,")
    got = readers.read_sheet(spark, str(tmp_path / "sheet.csv")).collect()
    assert len(got) == 2 and got[0]["ip"] == "CTCF" and got[1]["ip"] is None and got[0]["treatment"] is None
    (tmp_path / "s1.cov").write_text("chr1\t0\t10\t4\nchr1\t10\t20\t6\n")
    cov = readers.read_coverages(spark, [str(tmp_path / "s1.cov"), str(tmp_path / "gone.cov")]).collect()
    assert {(r["sample"], r["n"]) for r in cov} == {("s1", 4), ("s1", 6)}
    assert readers.read_coverages(spark, [str(tmp_path / "gone.cov")]).count() == 0
    (tmp_path / "tracks.txt").write_text("browser position chr1\ntrack type=bigWig name='a b' description='c' height=32 visibility=full maxHeightPixels=32:32:25 bigDataUrl=http://h/x.bw color=1,2,3\n")
    track = readers.read_tracks(spark, str(tmp_path / "tracks.txt")).first()
    assert (track["name"], track["height"], track["color"]) == ("a b", 32, "1,2,3")
    (tmp_path / "p.narrowPeak").write_text("chr1\t1\t5\tn\t9\t.\t1.5\t2\t3\t4\n")
    assert readers.read_peaks(spark, str(tmp_path / "p.narrowPeak")).first()["q_value"] == 3.0
    counts = spark.createDataFrame([("a", -1, 2, 5), ("a", 0, 3, 5), ("b", 0, 9, 9)], "name string, x long, n long, total long")
    sinks.write_cdt(counts, str(tmp_path / "cdt"), -1, 0)
    lines = spark.read.text(str(tmp_path / "cdt")).collect()
    assert [r[0] for r in lines if not r[0].startswith("X\t")] == ["b\tb\t1\t0\t9", "a\ta\t1\t2\t3"]
    calls = []
    make = lambda: calls.append(1) or counts
    for _ in range(2):
        assert sinks.memoised(spark, str(tmp_path / "memo"), make, ["name"]).count() == 3
    assert len(calls) == 1


def test_matrix_of_every_sample(spark):
    """Every position and every sample: a row's positions add up to its total."""
    from tallyspan.plans import genomics

    got = genomics.QUERIES["cdt_matrices"](spark, "/root/testdata/sf0.001").collect()
    assert len({r["sample"] for r in got}) == 7
    assert all(sum(r[f"X{x}"] for x in range(-400, 400)) == r["total"] for r in got)


def test_footprints_of_every_sample(spark):
    """A sample's posteriors are those of a run with its counts alone."""
    rng = np.random.default_rng(8)
    rows = [(s, f"s{k}", int(x), 1 + int(x) % 2) for s in ("a", "b") for k in range(30) for x in rng.choice(20, 9 if (k < 10) == (s == "a") else 2, replace=False)]
    sites = spark.createDataFrame([(f"s{k}", float(rng.normal(k < 10))) for k in range(32)], "name string, score double")
    counts = spark.createDataFrame(rows, "sample string, name string, x long, n long")
    both = footprint.footprint_posteriors(counts, sites, 20, rounds=2)
    got = {(r["sample"], r["name"]): r["posterior"] for r in both.collect()}
    assert len(got) == 64
    for s in "ab":
        for r in footprint.footprint_posteriors(counts.where(f"sample = '{s}'").drop("sample"), sites, 20, rounds=2).collect():
            assert got[s, r["name"]] == pytest.approx(r["posterior"], abs=1e-9)
    summary = footprint.posterior_summary(both).groupBy("sample").sum("n").collect()
    assert {r["sample"]: r["sum(n)"] for r in summary} == {"a": 32, "b": 32}


@pytest.mark.parametrize("t, df, p", [(12.7062047, 1, 0.05), (4.30265273, 2, 0.05), (2.570581836, 5, 0.05), (2.042272456, 30, 0.05), (2.75, 30, 0.0100), (1.96, 10**6, 0.049996), (0.0, 7, 1.0)])
def test_tabulated_p_values(t, df, p):
    assert stats.two_sided_p(t, df) == pytest.approx(p, abs=2e-5) and stats.two_sided_p(-t, df) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize("name", ["flat", "hanning", "hamming", "bartlett", "blackman"])
@pytest.mark.parametrize("width", [1, 2])
def test_narrow_kernels_change_nothing(spark, name, width):
    rows = spark.createDataFrame([("s", i, float(i)) for i in range(4)], "k string, p long, v double")
    assert X.kernel(name, width) == [1.0]
    assert [r["v"] for r in profiles.smooth(rows, ["k"], "p", "v", width, name).orderBy("p").collect()] == [0, 1, 2, 3]


def by_hand(rows, percent):
    want = set()
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[4], r[1], r[2], r[3], r[5]))
        want |= {(s, r[5]) for r in mine[: len(mine) * percent // 100]}
    return want


@pytest.mark.parametrize("kind", ["outlier", "ties", "spread", "mixed"])
def test_top_fractions_under_skew(spark, kind):
    """One outlier, one score for all, and both thresholds in one plan."""
    rng = random.Random(6)
    q = {"outlier": lambda k: 10**15 if k == 7 else rng.randrange(50), "ties": lambda k: 9, "spread": lambda k: rng.randrange(10**9), "mixed": lambda k: rng.choice([1, 1, 1, rng.randrange(10**6)])}[kind]
    rows = [(s, f"chr{rng.randrange(1, 4)}", rng.randrange(5_000_000), 0, q(k), k) for s, n in ((1, 3000), (2, 300), (3, 3)) for k in range(n)]
    p = spark.createDataFrame(rows, "sample int, chrom string, p_start long, p_end long, q long, peak_id long")
    got = peaks.top_fractions(p, [5, 25]).collect()
    for percent in (5, 25):
        assert {(r["sample"], r["peak_id"]) for r in got if r["percent"] == percent} == by_hand(rows, percent)
    assert len(got) == len(by_hand(rows, 5)) + len(by_hand(rows, 25))
    assert peaks.top_fraction(p.limit(0), 5).count() == 0


def test_sequences_of_equal_names_and_gaps(spark):
    reference = spark.createDataFrame([("c", 0, "AACC"), ("c", 4, "GGTT"), ("c", 12, "ACGT")], "chrom string, chunk_start long, seq string")
    rows = [("a", "c", 0, 4, "+"), ("a", "c", 4, 8, "+"), ("minus", "c", 2, 6, "-"), ("gap", "c", 6, 14, "+"), ("none", "d", 0, 4, "+"), ("empty", "c", 3, 3, "+"), ("end", "c", 14, 18, "+")]
    got = motifs.interval_sequences(spark.createDataFrame(rows, "name string, chrom string, start long, end long, strand string"), reference, 4).collect()
    assert sorted((r["name"], r["seq"] or "") for r in got) == [("a", "AACC"), ("a", "GGTT"), ("empty", ""), ("end", ""), ("gap", ""), ("minus", "CCGG"), ("none", "")]
    assert {r["name"] for r in got if r["seq"] is None} == {"gap", "none", "end"}


def test_scores_equal_plain_sums(spark):
    rng = random.Random(2)
    rows = [(f"s{k}", "".join(rng.choice("ACGT" if k % 3 else "ACGTN") for _ in range(rng.randrange(0, 90)))) for k in range(40)] + [("null", None)]
    got = {(r["name"], r["place"]): r["score"] for r in motifs.pwm_scores(spark.createDataFrame(rows, "name string, seq string")).collect()}
    want = {}
    for name, seq in rows:
        for place in range(len(seq or "") - 20):
            part = seq[place : place + 21]
            want[name, place] = None if "N" in part else sum(motifs.MOTIF[b][k] for k, b in enumerate(part))
    assert got.keys() == want.keys() and all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())


def test_peaks_of_several_kinds_and_strands(spark, tmp_path):
    (tmp_path / "a.narrowPeak").write_text("chr1\t1\t5\tn\t9\t1\t1.5\t2\t3\t4\n")
    (tmp_path / "b.broadPeak").write_text("chr1\t2\t5\tb\t9\t.\t1.5\t2\t3\n")
    (tmp_path / "c.bed").write_text("chr2\t3\t5\tc\t0.5\t0\n")
    got = {r["name"]: r for r in readers.read_peaks(spark, [str(tmp_path / n) for n in ("c.bed", "a.narrowPeak", "b.broadPeak")]).collect()}
    assert {n: (r["strand"], r["summit"], r["q_value"]) for n, r in got.items()} == {"n": ("-", 4, 3.0), "b": (".", None, 3.0), "c": ("+", None, None)}


def rows_read(df):
    """What the one scan of a collected plan has read, by its metrics."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_region_scan_reads_few_files_and_rows(spark, tmp_path):
    """One chromosome holds nearly all reads: files are cut by place all the same, and metrics tell what a region costs."""
    rng = random.Random(3)
    rows = [(1, "chr1" if k % 20 else rng.choice(["chr2", "chr3"]), at := rng.randrange(1_000_000), at + 50, "+", True, False, 5) for k in range(20_000)]
    path = str(tmp_path / "reads")
    with settings(spark, **{"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        layout.write_ordered(spark.createDataFrame(rows, READS), path, "chrom", "r_start", rows_per_group=200)
    files = [p for p in (tmp_path / "reads").iterdir() if p.suffix == ".parquet"]
    assert len(files) == 16
    found = layout.read_region(spark.read.parquet(path), "chr1", 500_000, 505_000)
    assert sorted(r["r_start"] for r in found.collect()) == sorted(r[2] for r in rows if r[1] == "chr1" and r[2] < 505_000 and r[3] > 500_000)
    assert 0 < rows_read(found) <= 3 * 200  # of 20,000: statistics of files and row groups decide
    sizes = [spark.read.parquet(str(p)).count() for p in files]
    assert max(sizes) < 3 * sorted(sizes)[8]


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    rng = random.Random(5)
    reads = spark.createDataFrame([cut_read(rng.randrange(-3000, 60_000), rng.choice("+-")) for _ in range(500)], READS)
    windows = spark.createDataFrame([(f"w{k}", "chr1", 4000 + 700 * k, 6000 + 700 * k, rng.choice("+-.")) for k in range(40)], WINDOWS)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        points = layout.bucketed(coverage.counted_cuts(reads), f"file://{tmp_path}/cuts", ["chrom", "_bin"], 4)
        spans = layout.bucketed(coverage.binned_windows(windows), f"file://{tmp_path}/windows", ["chrom", "_bin"], 4)
        joined = points.join(spans, ["chrom", "_bin"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        counts = coverage.counts_of(points, spans, ["chrom", "_bin"])
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, coverage.cut_counts(reads, windows).collect()))


def test_csv_sink(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "x int, y string"), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.schema("x int, y string").csv(str(tmp_path / "out"), header=True).collect()), key=str) == [(1, "a,b"), (2, None)]


def test_first_match(spark):
    df = spark.createDataFrame([("a", 3, True), ("a", 1, False), ("a", 2, True), ("b", 1, False)], "k string, n int, ok boolean")
    assert [tuple(r) for r in intervals.first_match(df, F.col("ok"), ["k"], "n").collect()] == [("a", 2, True)]


def test_axis_gaps(spark):
    """Every place of the axis once, whichever of them have counts."""
    counts = spark.createDataFrame([("s", "w", "+", -2, 3), ("s", "w", "-", 1, 4), ("t", "w", "+", 1, 1)], "sample string, name string, strand string, x long, n long")
    windows = spark.createDataFrame([("w", "chr1", 0, 4, "+")], WINDOWS)
    got = {(r["sample"], r["x"]): (r["average"], r["positive"], r["negative"]) for r in coverage.mean_profile(counts, windows, 4).collect()}
    assert got == {("s", -2): (1.5, 3.0, 0.0), ("s", -1): (0, 0, 0), ("s", 0): (0, 0, 0), ("s", 1): (2.0, 0, 4.0), ("t", -2): (0, 0, 0), ("t", -1): (0, 0, 0), ("t", 0): (0, 0, 0), ("t", 1): (0.5, 1.0, 0)}
    overlaps = spark.createDataFrame([("s", "w", "+", 1, 3), ("s", "w", "+", 2, 4)], "sample string, name string, strand string, lo long, hi long")
    assert [r["n"] for r in coverage.pileup_profile(overlaps, 4).orderBy("x").collect()] == [0, 1, 2, 1]


def test_footprint_percentiles(spark):
    rows = [(1, f"p{k}", k / 100) for k in range(101)] + [(2, "x", 0.5)]
    sheet = spark.createDataFrame([(1, "CTCF", "CM"), (2, "PU1", "CM"), (3, "IGG", "CM")], "sample int, ip string, technique string")
    together = footprint.by_assay(spark.createDataFrame(rows, "sample int, name string, posterior double"), sheet)
    got = {r["ip"]: r for r in footprint.posterior_percentiles(together, ["ip", "technique"]).collect()}
    assert (got["CTCF"]["n"], got["CTCF"]["p25"], got["CTCF"]["p50"], got["PU1"]["p75"]) == (101, 0.25, 0.5, 0.5) and len(got) == 2


def mixed_intervals(rng, n, axis=3_000_000_000):
    """From one base to a whole axis, ends near bounds of bins of every level among them."""
    rows = []
    for k in range(n):
        size = rng.choice([1, 2, 150, 1999, 2000, 2001, 16_000, 16_001, 128_000, 1_000_000, 8_000_000, 66_000_000, 300_000_000, axis])
        near = rng.choice([0, 2000, 16_000, 128_000, 1_024_000, 8_192_000, 65_536_000]) * rng.randrange(1, 4)
        start = max(0, min(axis - size, rng.choice([near - size // 2, near - 1, near, near - size, rng.randrange(axis), rng.randrange(20_000)])))
        rows.append((k, rng.choice(["chr1", "chr2"]), start, start + rng.choice([size, size, size, 0])))
    return rows


def test_overlaps_of_all_lengths(spark):
    """From one base to a whole chromosome: every pair once, and few rows after binning."""
    rng = random.Random(8)
    x, y = mixed_intervals(rng, 250), mixed_intervals(rng, 250)
    a = spark.createDataFrame(x, "i int, chrom string, a_start long, a_end long")
    b = spark.createDataFrame(y, "j int, chrom string, b_start long, b_end long")
    want = sorted((i, j) for i, c, s, e in x for j, d, t, f in y if c == d and s < f and t < e and s < e and t < f)
    assert sorted((r["i"], r["j"]) for r in intervals.overlap_pairs(a, b).collect()) == want
    assert sorted(r["i"] for r in intervals.overlapping(a, b, ["i"]).collect()) == sorted({i for i, _ in want})
    for asks, df, s, e, other in ((True, a, "a_start", "a_end", intervals.levels_of(b, "b_start", "b_end", "l")), (False, b, "b_start", "b_end", intervals.levels_of(a, "a_start", "a_end", "l"))):
        assert intervals.in_levels(df, s, e, other, asks).count() <= 2 * intervals.LEVELS * 250
    short = b.where("b_end - b_start <= 2000")
    assert intervals.in_levels(short, "b_start", "b_end", intervals.levels_of(short, "b_start", "b_end", "l"), True).count() <= 2 * short.count()


def test_a_long_interval_is_few_rows(spark):
    a = spark.createDataFrame([(1, "chr1", 0, 30_000_000)], "i int, chrom string, a_start long, a_end long")
    b = spark.createDataFrame([(k, "chr1", 1000 * k, 1000 * k + 200) for k in range(100)], "j int, chrom string, b_start long, b_end long")
    assert intervals.in_levels(a, "a_start", "a_end", intervals.levels_of(b, "b_start", "b_end", "l"), True).count() <= 2
    assert intervals.overlap_pairs(a, b).count() == 100


@pytest.mark.parametrize("chunk", [20, 33, 64, 5000])
def test_interval_scores_equal_the_whole_scan(spark, chunk):
    """At every seam, on both strands, with gaps in the reference and intervals from 20 bases to all of it."""
    rng = random.Random(6)
    genome = {c: "".join(rng.choice("ACGTACGTACGTN") for _ in range(n)) for c, n in (("c1", 400), ("c2", 97))}
    rows = [(c, at, g[at : at + chunk]) for c, g in genome.items() for at in range(0, len(g), chunk)]
    gap = next((r for r in rows[1:-1] if r[0] == "c1"), None)
    rows = [r for r in rows if r is not gap]
    if gap:
        genome["c1"] = genome["c1"][: gap[1]] + "N" * len(gap[2]) + genome["c1"][gap[1] + chunk :]
    spans = [("all", "c1", 0, 400, "+"), ("back", "c1", 0, 400, "-"), ("none", "c1", 5, 25, "+"), ("one", "c1", 5, 26, "-"), ("over", "c2", 60, 130, "-"), ("twice", "c2", 3, 44, "+"), ("twice", "c2", 4, 60, "-"), ("gone", "c9", 0, 40, "+")]
    intervals_df = spark.createDataFrame(spans, "name string, chrom string, start long, end long, strand string")
    got = sorted((r["name"], r["x"], r["score"]) for r in motifs.interval_scores(intervals_df, spark.createDataFrame(rows, "chrom string, chunk_start long, seq string"), chunk).collect() if r["score"] is not None)
    want, labels = [], 0
    for name, c, s, e, strand in spans:
        seq = (genome.get(c, "") + "N" * 500)[s:e]
        if strand == "-":
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for o in range(len(seq) - 20):
            labels += 1
            part = seq[o : o + 21]
            if "N" not in part:
                want.append((name, o - (len(seq) - 20) // 2, sum(motifs.MOTIF[b][k] for k, b in enumerate(part))))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)])
    assert motifs.interval_scores(intervals_df, spark.createDataFrame(rows, "chrom string, chunk_start long, seq string"), chunk).count() == labels


def test_a_long_interval_is_many_tasks(spark):
    reference = spark.range(200).select(F.lit("c").alias("chrom"), (F.col("id") * 1000).alias("chunk_start"), F.repeat(F.lit("ACGTT"), 200).alias("seq"))
    whole = spark.createDataFrame([("all", "c", 0, 200_000, "+")], "name string, chrom string, start long, end long, strand string")
    scores = motifs.interval_scores(whole, reference, 1000)
    tasks = scores.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("score").alias("k")).collect()
    assert sum(r["n"] for r in tasks) == sum(r["k"] for r in tasks) == 199_980 and min(r["lo"] for r in tasks) == -99_990 and max(r["hi"] for r in tasks) == 99_989
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):  # as if it were large
        assert motifs.interval_scores(whole, reference, 1000).select(F.spark_partition_id()).distinct().count() > 1


def test_long_sequences_are_scored_by_chunks(spark):
    rng = random.Random(12)
    rows = [(k, "".join(rng.choice("ACGTN") for _ in range(n))) for k, n in enumerate((0, 20, 21, 60, 61, 200))]
    df = spark.createDataFrame(rows, "name int, seq string")
    plain = sorted(map(tuple, motifs.pwm_scores(df).collect()), key=str)
    assert sorted(map(tuple, motifs.pwm_scores(df, chunk=7).collect()), key=str) == plain and len(plain) == 1 + 40 + 41 + 180


def test_pile_ups_are_counted_and_split(spark):
    """Half of all reads in one bin: the same counts, and no task with three times the median's rows."""
    rng = random.Random(9)
    rows = [cut_read(rng.randrange(2000), rng.choice("+-")) for _ in range(6000)] + [cut_read(rng.randrange(0, 400_000), rng.choice("+-")) for _ in range(6000)]
    reads = spark.createDataFrame([(rng.randrange(5), *r[1:]) for r in rows], READS)
    windows = spark.createDataFrame([(f"w{k}", "chr1", 4000 + 900 * k, 6000 + 900 * k, rng.choice("+-.")) for k in range(50)], WINDOWS)
    want = sorted(map(tuple, coverage.cut_counts(reads, windows).collect()))
    assert sorted(map(tuple, coverage.cut_counts(reads, windows, heaviest=100).collect())) == want and want
    points = coverage.cuts(reads).groupBy("sample", "chrom", "strand", "cut").agg(F.count(F.lit(1)).alias("_k")).withColumn("_bin", intervals.bin_of(F.col("cut")))
    spans = intervals.with_bins(windows, "w_start", "w_end", "_bin")
    dealt, repeated = coverage.split_bins(points, spans, 100)
    groups = {tuple(r)[:3]: r["count"] for r in dealt.groupBy("chrom", "_bin", "_part").count().collect()}
    whole = max(r["count"] for r in points.groupBy("chrom", "_bin").count().collect())
    assert whole > 2000 and max(groups.values()) < 150
    tasks = sorted(r["count"] for r in dealt.repartition(16, "chrom", "_bin", "_part").groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 3 * tasks[len(tasks) // 2]
    heavy = {(c, b) for c, b, p in groups if p}
    assert all((c, b, p) in {tuple(r) for r in repeated.select("chrom", "_bin", "_part").collect()} for c, b, p in groups if (c, b) in heavy)


def planted_sites(rng, samples=3, sites=240):
    """Cuts and scores of sites of which a third are bound: more cuts, and a dip in the middle."""
    counts, scores = [], []
    for k in range(sites):
        bound = k % 3 == 0
        scores.append((f"p{k}", (1.5 if bound else 0.0) + rng.gauss(0, 1)))
        for s in range(samples):
            for _ in range(rng.randrange(10, 40) if bound else rng.randrange(0, 12)):
                x = rng.randrange(-50, 50)
                if bound and abs(x) < 8:
                    continue
                counts.append((s, f"p{k}", x))
    return counts, scores


def test_accelerated_fit_is_as_likely_as_plain_rounds(spark):
    """Each sample as likely as after 300 plain rounds, planted sites told apart, and no sample bound to another's fit."""
    counts, scores = planted_sites(random.Random(2))
    cuts = spark.createDataFrame(counts, "sample int, name string, x long").groupBy("sample", "name", "x").agg(F.count(F.lit(1)).alias("n"))
    sites = spark.createDataFrame(scores, "name string, score double")
    table = footprint.site_table(cuts, sites).cache()
    fits = footprint.fitted(table, 100)
    blocks = footprint.Blocks(table, 100)
    at = {s: footprint.stepped(footprint.Parameters(), *first[0], 100) for s, first in blocks.sums(None).items()}
    packed = [r.asDict() for r in blocks.packed.collect()]
    for _ in range(300):
        sums = {}
        for block in packed:
            s = block["sample"]
            sums[s] = sums.get(s, 0) + footprint.block_sums(block, at[s], blocks.first, 100)
        named = {s: (dict(zip(footprint.ROUND, v)), {blocks.first + k: w for k, w in enumerate(v[len(footprint.ROUND) :])}) for s, v in sums.items()}
        plain = {s: footprint.objective(g["likelihood"], at[s]) for s, (g, _) in named.items()}
        at = {s: footprint.stepped(at[s], g, shape, 100) for s, (g, shape) in named.items()}
    ours = {s: footprint.objective(found[0][0]["likelihood"], fits[s]) for s, found in blocks.sums({s: [f] for s, f in fits.items()}).items()}
    assert ours.keys() == plain.keys() and all(ours[s] >= plain[s] - 0.01 for s in plain)
    posterior = {(r["sample"], r["name"]): r["p"] for r in footprint.expected(fits, table).collect()}
    right = [(p > 0.5) == (int(name[1:]) % 3 == 0) for (_, name), p in posterior.items()]
    assert np.mean(right) > 0.95
    alone = footprint.fitted(footprint.site_table(cuts.where("sample = 1"), sites).cache(), 100)[1]
    assert footprint.vector(alone) == pytest.approx(footprint.vector(fits[1]), abs=1e-6)


def test_block_sums_equal_the_column_ones(spark):
    """A round over packed blocks sums what the expressions of one expectation step do."""
    counts, scores = planted_sites(random.Random(4), 2, 60)
    cuts = spark.createDataFrame(counts, "sample int, name string, x long").groupBy("sample", "name", "x").agg(F.count(F.lit(1)).alias("n"))
    table = footprint.site_table(cuts, spark.createDataFrame(scores, "name string, score double")).cache()
    given = footprint.Parameters(-0.4, 0.7, (9.0, 3.0), (4.0, 1.2), {x: math.log(0.5 if abs(x) < 8 else 1.1) for x in range(-50, 50)})
    plain = footprint.round_sums(footprint.expected({0: given, 1: given}, table), "p")
    for s, found in footprint.Blocks(table, 100).sums({0: [given], 1: [given]}).items():
        g, shape = found[0]
        assert all(g[k] == pytest.approx(plain[s][0][k], rel=1e-7, abs=1e-7) for k in footprint.SUMS)
        assert all(shape[x] == pytest.approx(w) for x, w in plain[s][1].items())


def test_sizes_are_the_likeliest():
    """Newton steps by weighted slopes end at the size that a search finds."""
    rng = np.random.default_rng(5)
    t, w = rng.negative_binomial(2.5, 0.3, 4000).astype(float), rng.random(4000)
    mean, size = float((t * w).sum() / w.sum()), 1.0
    for _ in range(60):
        first, second = footprint.digammas(t + size)
        size = footprint.likelier_size(size, mean, w.sum(), (first * w).sum(), (second * w).sum())
    grid = np.linspace(size * 0.8, size * 1.25, 400)
    assert size == pytest.approx(grid[np.argmax([(footprint.nb_logs(t, mean, r) * w).sum() for r in grid])], rel=5e-3)


@pytest.mark.parametrize("tile", [512, 3])
def test_gram_matrix_equals_pairwise_correlations(spark, tile):
    """Windows missing from some samples, one constant sample, and a matrix of several tiles."""
    rng = np.random.default_rng(7)
    data = {(s, w): int(rng.poisson(5 + 3 * s)) if s != 4 else 6 for s in range(8) for w in range(300) if rng.random() < 0.8}
    rows = spark.createDataFrame([(s, w, n) for (s, w), n in data.items()], "sample int, win long, n long")
    got = {(r["sample1"], r["sample2"]): (r["r"], r["n"]) for r in stats.pearson_pairs(rows, tile).collect()}
    assert len(got) == 36
    for (a, b), (r, n) in got.items():
        both = [w for w in range(300) if (a, w) in data and (b, w) in data]
        assert n == len(both)
        if 4 in (a, b):
            assert r is None or abs(r) < 1e-6 or a == b
        else:
            assert r == pytest.approx(np.corrcoef([data[a, w] for w in both], [data[b, w] for w in both])[0, 1])


def test_gram_matrix_of_500_samples(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(9, (40, 500))
    rows = spark.createDataFrame([(s, w, int(x[w, s])) for w in range(40) for s in range(500)], "sample int, win long, n long")
    got = stats.pearson_pairs(rows, 200)
    want = np.corrcoef(x.T)
    found = {(r["sample1"], r["sample2"]): r["r"] for r in got.collect()}
    assert len(found) == 500 * 501 // 2 and all(found[a, b] == pytest.approx(want[a, b], abs=1e-9) for a, b in found)


def test_p_values_as_an_expression(spark):
    rows = [(t, df) for df in (1, 2, 3, 10, 57, 1000, 160_000) for t in (0.0, 0.01, 0.5, 1.0, -1.96, 2.5, 12.0, -60.0)] + [(None, 5), (1.0, 0)]
    got = stats.with_p(spark.createDataFrame(rows, "t double, df long").coalesce(1)).collect()
    for r in got:
        if r["t"] is None or r["df"] <= 0:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(stats.two_sided_p(r["t"], r["df"]), rel=1e-7, abs=1e-12)


def test_ranks_of_windows(spark):
    rng = random.Random(1)
    rows = [(s, f"w{k}", x, 1, rng.randrange(6)) for s in (1, 2) for k in range(300) for x in (0,)]
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = coverage.ranked_windows(spark.createDataFrame(rows, "sample int, name string, x int, n long, total long")).collect()
    for s in (1, 2):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[4], r[1]))
        assert [r["name"] for r in sorted(got, key=lambda r: r["rank"]) if r["sample"] == s] == [r[1] for r in own]
        assert sorted(r["rank"] for r in got if r["sample"] == s) == list(range(1, 301))


def test_memo_makes_only_what_is_missing_or_stale(spark, tmp_path):
    """A new sample, a changed input, a call that died half-way, and a part that has lost its rows."""
    path, inputs, asked = f"file://{tmp_path}/memo", tmp_path / "in", []
    inputs.mkdir()
    prints = lambda ks, **p: {k: sinks.fingerprint(spark, [f"file://{inputs}/{k[0]}.csv"], p) for k in ks}

    def make(keys):
        asked.append(sorted(keys))
        rows = [(s, g, int(line)) for s, g in keys for line in (inputs / f"{s}.csv").read_text().split()]
        return spark.createDataFrame(rows, "sample string, signal string, v int")

    def table(ks, **p):
        found = sinks.memoised_parts(spark, path, ["sample", "signal"], prints(ks, **p), make)
        return sorted((r["sample"], r["signal"], r["v"]) for r in found.collect())

    (inputs / "a.csv").write_text("1 2")
    (inputs / "b.csv").write_text("3")
    assert table([("a", "x")]) == [("a", "x", 1), ("a", "x", 2)] and asked == [[("a", "x")]]
    assert table([("a", "x"), ("b", "x")]) == [("a", "x", 1), ("a", "x", 2), ("b", "x", 3)] and asked[1:] == [[("b", "x")]]
    assert table([("a", "x"), ("b", "x")]) and len(asked) == 2
    (inputs / "a.csv").write_text("7")
    assert table([("a", "x"), ("b", "x")]) == [("a", "x", 7), ("b", "x", 3)] and asked[2:] == [[("a", "x")]]
    assert table([("b", "x")], width=5) == [("b", "x", 3)] and asked[3:] == [[("b", "x")]]
    good = make

    def dies(keys):
        good(keys)
        raise RuntimeError("lost")

    make = dies
    (inputs / "b.csv").write_text("8 9")
    with pytest.raises(RuntimeError):
        table([("b", "x")], width=5)
    make = good
    assert table([("b", "x")], width=5) == [("b", "x", 8), ("b", "x", 9)]
    (inputs / "b.csv").write_text("")
    assert table([("a", "x"), ("b", "x")], width=5) == [("a", "x", 7)]


def test_bootstrap_bounds_hold_the_mean(spark):
    rng = random.Random(2)
    rows = [(k, "g" if k % 3 else None, rng.gauss(5, 2)) for k in range(900)] + [(1000, "one", 1.5), (1001, "one", None)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = {r["k"]: r for r in stats.bootstrap_means(df, ["k"], "v", ["id"]).collect()}
    for k in ("g", None):
        v = [x for _, key, x in rows if key == k]
        assert got[k]["mean"] == pytest.approx(np.mean(v)) and got[k]["low"] < got[k]["mean"] < got[k]["high"]
        assert got[k]["high"] - got[k]["low"] == pytest.approx(3.92 * np.std(v) / len(v) ** 0.5, rel=0.25)
    assert (got["one"]["n"], got["one"]["low"], got["one"]["high"]) == (1, 1.5, 1.5)
    again = {r["k"]: (r["low"], r["high"]) for r in stats.bootstrap_means(df.repartition(5), ["k"], "v", ["id"]).collect()}
    assert all(again[k] == pytest.approx((got[k]["low"], got[k]["high"])) for k in again)
