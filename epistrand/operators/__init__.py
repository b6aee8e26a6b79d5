"""Operators over reads: cytosine, haplotype, region, variant and pattern reports, alignment and calling."""
