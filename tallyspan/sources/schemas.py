"""Schemas of the tables that the operators read; no source infers its types."""

BED = "chrom string, start long, end long, name string, score double, strand string"
NARROW_PEAK = "chrom string, start long, end long, name string, score int, strand string, signal_value double, p_value double, q_value double, summit int"
BROAD_PEAK = "chrom string, start long, end long, name string, score int, strand string, signal_value double, p_value double, q_value double"
WINDOW_COVERAGE = "chrom string, start long, end long, n long"
SAMPLE_SHEET = (
    "sample_name string, cell_line string, number_cells string, technique string, ip string, treatment string, experiment_name string, "
    "biological_replicate int, technical_replicate int, unmapped_bam string, genome string, read_type string, read_length int"
)
SITE_ANNOTATION = "name string, c1 string, score double, intercept int"
REFERENCE = "chrom string, chunk_start long, seq string"
READS = "sample string, chrom string, r_start long, r_end long, strand string, is_aligned boolean, is_duplicate boolean, tlen long"
