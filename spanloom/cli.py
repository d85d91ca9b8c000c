"""The command: ``python -m spanloom.cli ALIGNMENTS MATRICES [options]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .plans import adjudicate, view
from .session import builder
from .sources import readers, sinks
from .sources.pages import write_pages


def parser() -> argparse.ArgumentParser:
    d = Settings()
    p = argparse.ArgumentParser(prog="spanloom", description="Adjudicates competing, overlapping annotations of sequences.")
    p.add_argument("alignments", help="alignments, one in a line")
    p.add_argument("matrices", help="substitution matrices")
    p.add_argument("-J", "--query-jump", type=float, default=d.query_jump, metavar="f", help="probability of a jump between queries")
    p.add_argument("-L", "--skip-loop", type=float, default=d.skip_loop, metavar="n", help="skip loops that weigh as much as a jump")
    p.add_argument("-T", "--target-join-distance", type=int, default=d.target_join_distance, metavar="n", help="largest distance on the target across which alignments are joined")
    p.add_argument("-C", "--consensus-join-distance", type=int, default=d.consensus_join_distance, metavar="n", help="accepted, without effect")
    p.add_argument("-M", "--min-fragment-length", type=int, default=d.min_fragment_length, metavar="n", help="accepted, without effect")
    p.add_argument("-F", "--fudge-distance", type=int, default=d.fudge_distance, metavar="n", help="tolerance of gaps and fragments")
    p.add_argument("-U", "--repeats", metavar="path", help="tandem repeats (JSON)")
    p.add_argument("--out", metavar="path", help="folder for the annotations; without it they are printed")
    p.add_argument("--viz", action="store_true", help="write a page for each region")
    p.add_argument("--assembly-viz", action="store_true", help="write a page for each query and strand of a region")
    p.add_argument("--viz-out", default="./viz", metavar="path", help="folder for the pages")
    p.add_argument("--viz-ref-bed", metavar="path", help="reference annotations for the pages (BED, sorted)")
    return p


def settings(args: argparse.Namespace) -> Settings:
    names = ("query_jump", "skip_loop", "target_join_distance", "consensus_join_distance", "min_fragment_length", "fudge_distance")
    return Settings(**{n: getattr(args, n) for n in names})


def checked(bed: DataFrame) -> DataFrame:
    """``bed``, if each chromosome's lines stand together and its starts never fall."""
    bad = readers.bed_order(bed).where(~F.col("sorted") | ~F.col("contiguous")).orderBy("first_line").first()
    if bad is not None:
        raise ValueError(f"the BED file is not sorted: {bad['chrom']}")
    return bed


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    chosen = settings(args)
    spark = builder().getOrCreate()
    pages = args.viz or args.assembly_viz
    alignments = readers.read_alignments(spark, args.alignments)
    repeats = None if args.repeats is None else readers.read_repeats(spark, args.repeats)
    bed = None if args.viz_ref_bed is None or not args.viz else checked(readers.read_bed(spark, args.viz_ref_bed))
    found = adjudicate.outputs(alignments, readers.read_matrices(spark, args.matrices), repeats, chosen, detail=pages)
    if pages:
        found = found.persist()  # the annotations and both kinds of pages come from one run
    annotations = adjudicate.as_annotations(found)
    if args.out is not None:
        sinks.write_text(annotations, args.out)
    else:
        for row in sinks.text_lines(annotations).toLocalIterator():
            print(row["line"])
    if pages:
        with_ids, known = adjudicate.with_ids(alignments, repeats)
        located, _ = adjudicate.located(with_ids, known, chosen)
        if args.viz:
            write_pages(sinks.pages(view.region_payloads(found, located, readers.query_lengths(alignments), bed)), f"{args.viz_out.rstrip('/')}/regions")
        if args.assembly_viz:
            write_pages(sinks.pages(view.assembly_payloads(found, located, chosen.target_join_distance)), f"{args.viz_out.rstrip('/')}/assemblies")
        found.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
