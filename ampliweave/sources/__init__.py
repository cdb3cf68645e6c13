"""Sources and sinks: FASTQ, FASTA, whitelists, SAM, BAM and single-cell tables, all through Spark's readers."""
