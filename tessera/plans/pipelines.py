"""The three programs as DataFrame plans: draft (contact graph), correct (split sequences), partition (groups)."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.motifs import resolve_motif
from tessera.operators import align, contacts, edges, motif, pairing, segments, split
from tessera.operators.partition import partition as partition_groups
from tessera.session import materialize

log = logging.getLogger("tessera")


@dataclass(frozen=True)
class DraftConfig:
    """``half_range``: what a site's window reaches to either side; ``least_sites``: contigs of fewer are invalid."""

    enzyme: str
    mapq: int = 40
    half_range: int = 500
    least_sites: int = 0
    ignore_case: bool = False


@dataclass(frozen=True)
class Draft:
    """What draft gives: contigs, their sites, invalid ids, read pairs between contigs, and weighted edges."""

    contigs: DataFrame
    sites: DataFrame
    invalid: DataFrame
    read_pairs: DataFrame
    edges: DataFrame


def draft(contigs: DataFrame, records: DataFrame, config: DraftConfig) -> Draft:
    """Contigs (id, name, seq, length) and records (file, rec_no, ref_name, pos, next_ref_name, next_pos, mapq) to a graph.

    A record counts if its quality does, both its contigs are known and valid, and its own position lies in a window;
    pairs need both directions, so the mate's position is looked at when its own record comes.
    """
    m = resolve_motif(config.enzyme)
    sites = motif.contig_sites(contigs, m, config.ignore_case)
    windows = motif.windows_around_sites(contigs, m, config.half_range, config.ignore_case)
    invalid = motif.invalid_contigs(sites, config.least_sites)
    good = align.named_to_ids(align.quality_filter(records, config.mapq), contigs)
    good = align.positions_in_windows(align.without_contigs(good, invalid), windows)
    # A mate without a position can't pair, but as defined it still takes its read's place.
    # What passes the filters is written, as pairing reads it several times and alignments are large.
    good = materialize(good.withColumn("next_pos", F.coalesce("next_pos", F.lit(-1))), "good-records")
    pairs = materialize(pairing.mate_pairs(good), "pairs")
    weighed = edges.edge_weights(edges.edge_counts(pairs), sites)
    return Draft(contigs.select("id", "name", "length"), sites, invalid, edges.inter_contig(pairs), weighed)


@dataclass(frozen=True)
class CorrectConfig:
    percent: float = 0.95
    sensitivity: float = 0.5
    mapq: int = 1
    wide: int = 25_000
    narrow: int = 1_000
    depletion: int = 100_000
    warnings: list[str] = field(default_factory=list, compare=False)

    def __post_init__(self) -> None:
        if self.depletion % self.wide or self.wide % self.narrow:
            self.warnings.append("a bin size that doesn't divide its depth leaves a grid without scores")
        if self.narrow >= self.wide or self.depletion < 2 * self.wide:
            self.warnings.append("bins should be narrow < wide, and the depletion twice the wide bin at least")
        for w in self.warnings:
            log.warning(w)


def mismatches(records: DataFrame, config: CorrectConfig) -> DataFrame:
    """``(contig_id, a, b)``: depleted segments of contigs, from records within them (contig_id, pos, next_pos)."""
    hist = materialize(contacts.contact_histogram(records, [config.wide, config.narrow]), "contacts")
    sat = contacts.saturation(hist, config.percent)
    wide_sat = contacts.wide_saturation(sat, config.wide)
    wide_score = contacts.spanning_score(hist, wide_sat, config.wide, config.depletion)
    wide = materialize(segments.wide_regions(contacts.score_grid(wide_score, config.wide, config.depletion), wide_sat, config.sensitivity, config.wide, config.depletion), "wide")
    narrow_score = contacts.spanning_score(hist.join(wide.select("contig_id").distinct(), "contig_id", "left_semi"), sat, config.narrow, config.wide)
    return segments.narrow_regions(wide, contacts.score_grid(narrow_score, config.narrow, config.wide), config.narrow)


def correct(contigs: DataFrame, records: DataFrame, config: CorrectConfig) -> DataFrame:
    """``(id, ord, name, seq)``: contigs cut at their depleted segments. Two contigs of one name are an error."""
    named = align.assert_unique_names(contigs).select(F.col("name").alias("ref_name"), F.col("id").alias("contig_id"))
    inside = align.same_contig_filter(records, config.mapq).join(named, "ref_name")
    return split.split_sequences(contigs, mismatches(inside, config))


@dataclass(frozen=True)
class PartitionConfig:
    groups: int
    allele_groups: int = -1
    heaviest_first: bool = False
    steepest: bool = False

    def __post_init__(self) -> None:
        if self.groups < 1:
            raise ValueError("groups must be 1 or more")
        if self.allele_groups != -1 and self.allele_groups < 2:
            raise ValueError("allele groups must be 2 or more, or -1")


def partition(contigs: DataFrame, edge_table: DataFrame, config: PartitionConfig) -> DataFrame:
    """``(group_id, contig_id)``."""
    return partition_groups(contigs, edge_table, config.groups, heaviest_first=config.heaviest_first, steepest=config.steepest)
