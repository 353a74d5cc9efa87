"""Picking models for hardware: ordered filter cascades over a ranked candidate table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIB = 1 << 30
# Quality penalty of each quantisation format.
QUANT_PENALTY = {
    "F32": 0.0, "F16": 0.0, "BF16": 0.0, "Q8_0": 0.01, "Q6_K": 0.02, "Q5_K_M": 0.03, "Q5_K_S": 0.035, "Q5_0": 0.035,
    "Q4_K_M": 0.05, "NVFP4": 0.05, "IQ4_XS": 0.05, "Q4_K_S": 0.055, "IQ4_NL": 0.055, "Q4_0": 0.06, "MXFP4": 0.06,
    "Q3_K_L": 0.075, "Q3_K_M": 0.08, "Q3_K_S": 0.12, "IQ3_XS": 0.16, "IQ3_M": 0.16, "IQ3_S": 0.17, "IQ3_XXS": 0.18, "Q2_K": 0.25,
}


def vram_headroom(vram: Column) -> Column:
    """Bytes kept free: 5 %, but 512 MiB to 2 GiB; none without memory."""
    return F.when(vram <= 0, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(512.0 * 2**20), F.least(vram * F.lit(0.05), F.lit(2.0 * GIB))))).cast("long")


def platform_class(usable: Column, shared: Column) -> Column:
    """[F23]"""
    gb = usable / F.lit(float(GIB))
    return F.when(gb < 1.0, "cpu_only").when(shared | (gb <= 10.0), "igpu_shared").when(gb <= 20.0, "dgpu_small").otherwise("dgpu_large")


def platforms(gpus: DataFrame, by: str = "machine") -> DataFrame:
    """[M2, A8] Memory summed over a machine's GPUs; one shared makes all shared."""
    out = gpus.groupBy(by).agg(F.coalesce(F.sum("usable_vram_bytes"), F.lit(0)).cast("long").alias("usable_vram_bytes"), F.coalesce(F.bool_or("shared_memory"), F.lit(False)).alias("shared_memory"), F.count("usable_vram_bytes").alias("gpu_count"))
    return out.withColumn("platform_class", platform_class(F.col("usable_vram_bytes"), F.col("shared_memory")))


def quant_acceptable(quant: Column, min_tier: str) -> Column:
    """[F24, J8] Unknown and null formats fail; an unknown tier is an error."""
    most = QUANT_PENALTY.get(min_tier.upper())
    if most is None:
        raise ValueError(f"unknown quantisation {min_tier!r}; known: {', '.join(sorted(QUANT_PENALTY))}")
    return F.coalesce(F.upper(quant).isin(*[q for q, p in QUANT_PENALTY.items() if p <= most]), F.lit(False))


def truncation_warning(warnings: Column) -> Column:
    """The first warning about the native context, else null."""
    return F.get(F.filter(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.contains(F.lower(w), F.lit("max context"))), F.lit(0))


def any_of(text: Column, patterns: list[str], test) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | test(text, F.lit(p.lower()))
    return out


def language_ok(model: Column, languages: Column, target: str, exclude: list[str], ignore_tags_for: list[str]) -> Column:
    """Name patterns reject; freed models and models without tags pass; else the target or `multilingual` must be listed."""
    low = F.lower(model)
    tags = F.transform(languages, lambda t: F.lower(t))
    listed = F.array_contains(tags, "multilingual") | F.array_contains(tags, target.lower())
    return F.when(any_of(low, exclude, F.contains), F.lit(False)).when(low.isin(*[m.lower() for m in ignore_tags_for]) if ignore_tags_for else F.lit(False), F.lit(True)).otherwise(F.coalesce(listed, F.lit(True)))


@dataclass
class Criteria:
    """What a generator has to satisfy."""

    device: str = "gpu"
    exclude_patterns: list[str] = field(default_factory=list)
    exclude_suffixes: list[str] = field(default_factory=list)
    min_params_b: float = 0.0
    min_quant: str = "Q4_K_S"
    language: str = ""
    language_exclude: list[str] = field(default_factory=list)
    ignore_tags_for: list[str] = field(default_factory=list)


def reject_reason(c: Criteria) -> Column:
    """[P7] The first test that a candidate fails, in order, cheapest first; null if it passes all."""
    low = F.lower(F.col("model_id"))
    out = F.when(~F.coalesce(F.col("can_run"), F.lit(False)), "cannot_run")
    out = out.when(any_of(low, c.exclude_patterns, F.contains), "name_pattern").when(any_of(low, c.exclude_suffixes, F.endswith), "name_suffix")
    out = out.when(F.coalesce(F.col("parameter_count"), F.lit(0)) / 1e9 < c.min_params_b, "too_small").when(~quant_acceptable(F.col("quant_type"), c.min_quant), "quantisation")
    out = out.when(truncation_warning(F.col("warnings")).isNotNull(), "context")
    if c.language:
        out = out.when(~language_ok(F.col("model_id"), F.col("languages"), c.language, c.language_exclude, c.ignore_tags_for), "language")
    return out.when(F.coalesce(F.col("fit_type") != "full_gpu", F.lit(True)), "partial_fit") if c.device == "gpu" else out


def resolve_generator(candidates: DataFrame, c: Criteria, by: str = "platform") -> DataFrame:
    """[M4, P7] For each platform the first survivor in rank order; else the first that only fails to fit wholly; else null with the reasons of the first ten.

    candidates: platform, rank, model_id, can_run, parameter_count, quant_type, warnings, languages, fit_type.
    """
    rows = candidates.withColumn("reason", reject_reason(c))
    pick = lambda ok: F.min_by("model_id", F.when(ok, F.col("rank")))
    won, second = pick(F.col("reason").isNull()), pick(F.col("reason") == "partial_fit")
    first = F.row_number().over(Window.partitionBy(by).orderBy("rank", "model_id"))
    no = rows.filter(F.col("reason").isNotNull()).withColumn("_n", first).filter("_n <= 10").groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat("model_id", F.lit(": "), "reason").alias("why")))), lambda x: x["why"]).alias("rejected"))
    out = rows.groupBy(by).agg(F.max(F.col("reason").isNull()).alias("_won"), F.max(F.coalesce(F.col("reason") == "partial_fit", F.lit(False))).alias("_second"), won.alias("_a"), second.alias("_b")).join(no, by, "left")
    return out.select(by, F.when(F.col("_won"), F.col("_a")).when(F.col("_second"), F.col("_b")).alias("model_id"), (~F.col("_won") & F.col("_second")).alias("fallback"), F.coalesce("rejected", F.array().cast("array<string>")).alias("rejected"))


def generator_budget(platforms: DataFrame, roles: DataFrame, by: str = "machine") -> DataFrame:
    """[M3, M5, A8] Memory left for the generator after GPU-resident side roles (machine, device, vram_bytes); not positive is an error row."""
    reserved = roles.filter("device = 'gpu'").groupBy(by).agg(F.sum("vram_bytes").alias("reserved"))
    out = platforms.join(reserved, by, "left").withColumn("reserved", F.coalesce("reserved", F.lit(0)).cast("long")).withColumn("budget", F.col("usable_vram_bytes") - F.col("reserved"))
    return out.select(by, "usable_vram_bytes", "reserved", "budget", (F.col("budget") > 0).alias("ok"))


def backend_choice(explicit: str | None, index: str | None, platform: str | None, default: str = "sqlite-vec") -> str:
    """[D11, D12, M11] Explicit, then what the index has, then the platform, then the default."""
    return explicit or index or platform or default


def preferred(explicit: str | None, stored: str | None, platform: str | None, default: str, what: str = "backend") -> tuple[str, list[str]]:
    """[D11, D12, M11] The choice of backend_choice, and what was passed over for it: an index that holds something else cannot be read with the choice, so that comes first."""
    choice, notes = backend_choice(explicit, stored, platform, default), []
    if stored and stored != choice:
        notes.append(f"the index has the {what} {stored}; with {choice} it has to be rebuilt")
    if platform and platform != choice:
        notes.append(f"the platform suggests the {what} {platform}, {choice} is used")
    return choice, notes
