"""Fixed column layouts. Positions are 0-based; ends are inclusive."""

REFERENCE = "contig string, contig_len long, tile int, tile_start long, bases string"
VARIANTS = "vcf_key string, contig string, rec_no long, pos long, rlen int, ref_end long, alleles array<string>, var_is_ref boolean, gt array<string>"
CONTIGS = "vcf_key string, contig string, declared boolean"
SAMPLES = "vcf_key string, sample string, sample_idx int"
MASK = "contig string, beg long, fin long"
TASKS = "idx long, chr string, start long, `end` long, vcf_key string, gene_id string, sample string, haplotype string"
RESULTS = "idx long, gene_id string, sample string, haplotype string, seq string, chain string, error string, failure_kind string, lane string, napplied long"
TILE = 1 << 16
