"""Queries of the package's operators over the trade-mark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .cross_split import overlaps
from .grouped_split import related_groups, split_groups
from .marks import MARKS, folded_pairs, plain_marks, usable_pairs
from .mixing import Mix, mix_sources
from .multiset_duplicates import duplicate_groups
from .packing import pack_items
from .plain_form import folded, plain_forms, terms
from .term_counts import band, count_terms
from .text_quality import document_statistics, flag_tails
from .tokens import token_count

#: Wanted shares of the splits.
SHARES = {"treino": 0.70, "validacao": 0.15, "teste": 0.15}


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and usable pairs of every term."""
    rows = plain_marks(spark, folder).select("pair_id", terms(F.col("plain")).alias("terms"))
    counted = count_terms(rows, "pair_id", "terms")
    return counted.select(F.col("term").alias("termo"), F.col("occurrences").alias("ocorrencias"), F.col("records").alias("pares"), band("records", usable_pairs(spark, folder).count()).alias("faixa"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_counts(spark, folder).where("faixa is not null").select("termo", "faixa")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return plain_marks(spark, folder).where("value <> plain").select("pair_id", F.col("field").alias("campo"))


def p4_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Both marks of every usable pair as stored and in plain form."""
    return plain_marks(spark, folder).select("pair_id", F.col("field").alias("campo"), F.col("value").alias("valor"), F.col("plain").alias("forma"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered-again pair with the first of its copies and their number."""
    pairs = folded_pairs(spark, folder, "classe_marca_monitorada")
    found = duplicate_groups(pairs, "pair_id", ["a", "b"], ["classe_marca_monitorada"])
    return found.select(F.col("first").alias("pair_id_primeiro"), F.col("key").alias("pair_id"), F.col("copies").alias("copias"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_groups(spark, folder).where("pair_id <> pair_id_primeiro").select("pair_id_primeiro", F.col("pair_id").alias("pair_id_copia"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """``(record, mark)``: the folded marks of the usable pairs and of the watched marks."""
    pairs = usable_pairs(spark, folder).select(F.col("pair_id").alias("record"), F.explode(F.array(*MARKS)).alias("mark"))
    watched = table(spark, folder, "carteira").select(F.col("carteira_id").alias("record"), F.col("marca_monitorada").alias("mark"))
    return plain_forms(pairs.unionByName(watched), ["record"], ["mark"]).select("record", folded(F.col("plain")).alias("mark"))


def _related(spark: SparkSession, folder: str) -> DataFrame:
    return related_groups(_records(spark, folder), "record", "mark")


def _split(spark: SparkSession, folder: str) -> DataFrame:
    """``(record, group, split)`` of every usable pair, by the search over whole groups."""
    pairs = usable_pairs(spark, folder).select("pair_id", "label")
    rows = _related(spark, folder).join(pairs, F.col("record") == F.col("pair_id")).select("pair_id", "group", "label")
    return split_groups(rows, "pair_id", "group", "label", SHARES)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The groups that the search has kept together."""
    return _split(spark, folder).where("record <> group").select(F.col("group").alias("grupo_id"), F.col("record").alias("pair_id"))


def p1_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable pair with its group and split."""
    return _split(spark, folder).select(F.col("record").alias("pair_id"), F.col("group").alias("grupo_id"), "split")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each split's pairs, groups, shares of the pairs and of those with label 1, and how far these lie from the share wanted."""
    rows = cut_lineage(_split(spark, folder).join(usable_pairs(spark, folder).select(F.col("pair_id").alias("record"), (F.col("label") == 1).cast("int").alias("p")), "record"))
    groups = rows.groupBy("split", "group").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    splits = groups.groupBy("split").agg(F.sum("n").alias("pares"), F.count("*").alias("grupos"), F.coalesce(F.sum("p"), F.lit(0)).alias("positivos"))
    total = splits.agg(F.sum("pares").alias("n"), F.sum("positivos").alias("p"))  # one row
    wanted = F.create_map(*[F.lit(x) for pair in SHARES.items() for x in pair])[F.col("split")]
    made = splits.crossJoin(F.broadcast(total)).withColumns({"parte": F.col("pares") / F.col("n"), "parte_positivos": F.col("positivos") / F.col("p")})
    return made.select("split", "pares", "grupos", "positivos", "parte", "parte_positivos", (F.col("parte") - wanted).alias("desvio"), (F.col("parte_positivos") - wanted).alias("desvio_positivos"))


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, groups, and groups that the split has parted (none)."""
    groups = _split(spark, folder).groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    return groups.agg(F.sum("n").alias("pares"), F.count("*").alias("grupos"), F.sum((F.col("splits") > 1).cast("bigint")).alias("partidos"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _overlaps(spark, folder)
    return found.select(F.least("train_key", "other_key").alias("pair_id_a"), F.greatest("train_key", "other_key").alias("pair_id_b"))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    pairs = folded_pairs(spark, folder).join(table(spark, folder, "divisao").select("pair_id", "split"), "pair_id")
    return overlaps(pairs, "pair_id", "a", "b", "split", "treino")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps with treino by split and fonte of the evaluated pair: links, pairs concerned, equal ones, links whose labels disagree."""
    facts = usable_pairs(spark, folder).select("pair_id", "fonte", "label").join(table(spark, folder, "divisao").select("pair_id", "split"), "pair_id")
    other = facts.select(F.col("pair_id").alias("other_key"), "split", "fonte", F.col("label").alias("own"))
    train = facts.select(F.col("pair_id").alias("train_key"), F.col("label").alias("its"))
    linked = _overlaps(spark, folder).join(other, "other_key").join(train, "train_key")
    per_pair = linked.groupBy("split", "fonte", "other_key").agg(F.count("*").alias("n"), F.sum((F.col("edits") == 0).cast("int")).alias("e"), F.sum((~F.col("own").eqNullSafe(F.col("its"))).cast("int")).alias("d"))
    return per_pair.groupBy("split", "fonte").agg(F.sum("n").alias("ligacoes"), F.count("*").alias("pares"), F.sum("e").alias("iguais"), F.sum("d").alias("rotulos_diferentes"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of one, in its container."""
    packed = pack_items(_sized(spark, folder), "doc_id", "tokens", capacity=4096)
    return packed.select("container", F.col("key").cast("bigint").alias("doc_id"), F.col("piece").alias("parte"), "tokens", F.col("filled").alias("ocupado"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers closed on each level of the tree, the tokens in them and the share of their room that these fill; ``nivel`` null holds all levels."""
    packed = pack_items(_sized(spark, folder), "doc_id", "tokens", capacity=4096).where("container is not null")
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).withColumn("nivel", F.split_part("container", F.lit(":"), F.lit(1)).cast("int"))
    levels = bins.rollup("nivel").agg(F.count("*").alias("caixas"), F.sum("tokens").alias("tokens"))
    return levels.withColumn("enchimento", F.col("tokens") / (F.col("caixas") * 4096))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut."""
    return p7_containers(spark, folder).where("parte = 1").select("doc_id")


def _mix(spark: SparkSession, folder: str) -> Mix:
    targets = table(spark, folder, "mistura_alvo").select("source", "peso_alvo", "max_repeticoes")
    return mix_sources(_sized(spark, folder), "doc_id", "tokens", "source", targets)


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's target, the tokens planned for it, and the tokens and share that the selection takes."""
    return _mix(spark, folder).report.withColumnsRenamed({"chosen": "planned", "taken": "chosen"})


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return _mix(spark, folder).selection.select(F.col("key").alias("doc_id"), "source", F.col("uses").alias("vezes"), "tokens")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).where("short").select("source")


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document, its place in its language's distribution, and whether it is prose."""
    made = flag_tails(document_statistics(table(spark, folder, "documents"), "doc_id", "text", "lang"))
    return made.withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_statistics(spark, folder).where("not prose").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_split, p1_report, p1_kept, p3_found, p3_counts, p4_found, p4_plain, p5_found, p5_groups, p6_found, p6_report,
        p7_found, p7_containers, p7_report, p8_found, p8_report, p8_selection, p9_found, p9_statistics,
    )
}
