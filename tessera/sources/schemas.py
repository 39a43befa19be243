"""Schemas of the catalog tables and annotation files."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "locus": "locus_uid string, combined_id string, versioned_id string, `group` string, band string, origin string",
    "locus_alias": "locus_uid string, alias string, alias_type string, assignment string, is_current int",
    "locus_coord": "locus_uid string, assembly string, chrom string, start bigint, end bigint, strand string, span bigint, contig_type string, coord_unreliable int, lift_method string",
    "locus_segment": "locus_uid string, seg_index int, segment_class string, repName string, repFamily string, repClass string, chrom string, start bigint, end bigint, strand string, span bigint, rmsk_sw_score int",
    "locus_structure": "locus_uid string, structure string, category string, ltr_names string, int_names string, is_tandem_or_nested int",
    "locus_repeat": "locus_uid string, assembly string, chrom string, start bigint, end bigint, strand string, rep_name string, rep_class string, rep_family string, pct_div double, n_loci int",
    "hit_gene": "locus_uid string, genome string, source string, ref_gene_name string, ref_gene_id string, gene_type string, overlap_type string, overlap_bp bigint, exon_overlap_bp bigint, n_transcripts int",
    "hit_geve": "locus_uid string, geve_orf_id string, orf_class string, hg38_chrom string, hg38_orf_start bigint, hg38_orf_end bigint, orf_strand string",
    "hit_hervarium_domain": "locus_uid string, gene string, domain_desc string, element string, status string, domain_score double, hg38_start bigint, hg38_end bigint, strand string",
    "aln_crossgenome": "locus_uid string, pct_identity double, xg_class string, edit_dist bigint",
    "hit_dfam_aln": "locus_uid string, dfam_accession string, consensus_name string, pct_identity double, cons_cov double, sw_score int, aln_quality string, is_best_by_sw_score int",
    "transcripts": "name string, name2 string, chrom string, txStart bigint, txEnd bigint, strand string, exonStarts array<bigint>, exonEnds array<bigint>",
}
#: Fields of a transcript in tile payloads; exon lists come comma-packed.
TILE_RECORD = "name string, name2 string, chrom string, txStart bigint, txEnd bigint, strand string, exonStarts string, exonEnds string"
