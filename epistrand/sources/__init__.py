"""Sources and sinks: BAM, FASTA, BED, VCF, TSV reports, simulated alignments."""
