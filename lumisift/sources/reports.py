"""Nested XML reports, one file per target, as one row per detected signal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import decode_bitmask
from ..functions.nulls import over, to_bool, to_double, to_long
from .elements import Layout, parsed

ROOT = "dvTargetResults"
#: Model parameters by their names in a report.
MODEL_PARAMETERS = {
    "transitEpochBtjd": "transit_epoch_btjd",
    "minImpactParameter": "min_impact_parameter",
    "orbitalPeriodDays": "orbital_period_days",
    "ratioPlanetRadiusToStarRadius": "ratio_planet_radius_to_star_radius",
    "ratioSemiMajorAxisToStarRadius": "ratio_semi_major_axis_to_star_radius",
    "transitDurationHours": "transit_duration_hours",
    "transitDepthPpm": "transit_depth_ppm",
}
#: Stellar properties by element, whose attribute `value` holds the number.
STELLAR = {
    "raDegrees": "ra_deg", "decDegrees": "dec_deg", "pmRa": "pm_ra", "pmDec": "pm_dec", "tessMag": "tess_mag",
    "effectiveTemp": "effective_temp", "radius": "radius", "log10SurfaceGravity": "log_g",
    "log10Metallicity": "log_metallicity", "stellarDensity": "stellar_density",
}


_MOTION, _GHOST = "centroidResults/differenceImageMotionResults", "ghostDiagnosticResults"
#: What is read of a report and of each of its signals.
TARGET = Layout({
    "": ("ticId", "toiId", "planetCandidateCount", "sectorsObserved", "startCadence", "endCadence", "pipelineTaskId"),
    **{name: ("value",) for name in STELLAR},
    "limbDarkeningModel": ("modelName", "coefficient1", "coefficient2", "coefficient3", "coefficient4"),
}, lists={"matchedToiId": None})
SIGNAL = Layout({
    "": ("planetNumber", "toiId", "toiCorrelation", "detrendFilterLength"),
    "planetCandidate": ("suspectedEclipsingBinary", "maxSingleEventSigma", "maxMultipleEventSigma", "robustStatistic", "modelChiSquare2", "modelChiSquareDof2", "modelChiSquareGof", "modelChiSquareGofDof"),
    "planetCandidate/weakSecondary": ("mesMad", "robustStatistic"),
    "allTransitsFit": ("fullConvergence", "modelChiSquare", "modelDegreesOfFreedom", "modelFitSnr", "transitModelName"),
    "binaryDiscriminationResults/oddEvenTransitDepthComparisonStatistic": ("value", "significance"),
    "bootstrapResults": ("significance",),
    f"{_MOTION}/msTicCentroidOffsets/meanSkyOffset": ("value", "uncertainty"),
    f"{_MOTION}/msControlCentroidOffsets/meanSkyOffset": ("value", "uncertainty"),
    f"{_GHOST}/coreApertureCorrelationStatistic": ("value", "significance"),
    f"{_GHOST}/haloApertureCorrelationStatistic": ("value", "significance"),
}, named=("allTransitsFit/modelParameters", "modelParameter", list(MODEL_PARAMETERS), ("value", "uncertainty")), lists={"differenceImageResults": "sector"})
#: What errors are told by: the target's id and the signals' numbers.
TARGET_ID, SIGNAL_NUMBER = Layout({"": ("ticId",)}), Layout({"": ("planetNumber",)})


def _text(value: Column) -> Column:
    """Text without the blanks around it."""
    return F.btrim(value, F.lit(" \t\r\n"))


def target_columns(r: Column, bit_order: str = "right") -> dict[str, Column]:
    sectors = _text(r["_sectorsObserved"])
    return {
        "tic_id": to_long(r["_ticId"]),
        "toi_id": _text(r["_toiId"]),
        "planet_candidate_count": to_long(r["_planetCandidateCount"]),
        "sectors_observed_bitmask": sectors,
        "start_cadence": to_long(r["_startCadence"]),
        "end_cadence": to_long(r["_endCadence"]),
        "pipeline_task_id": to_long(r["_pipelineTaskId"]),
        "sectors_observed": F.coalesce(decode_bitmask(sectors, bit_order), F.array().cast("array<int>")),
        "matched_toi_ids": F.filter(F.transform(r["matchedToiId"], _text), lambda x: x.isNotNull() & (x != "")),
        **{out: to_double(r[f"{name}_value"]) for name, out in STELLAR.items()},
        "limb_darkening_model": _text(r["limbDarkeningModel_modelName"]),
        **{f"limb_darkening_c{i}": to_double(r[f"limbDarkeningModel_coefficient{i}"]) for i in range(1, 5)},
    }


def signal_columns(p: Column) -> dict[str, Column]:
    number = lambda path, name: to_double(p[f"{path}_{name}"])
    candidate, weak, fit = "planetCandidate", "planetCandidate/weakSecondary", "allTransitsFit"
    odd_even = "binaryDiscriminationResults/oddEvenTransitDepthComparisonStatistic"
    sky = {out: f"{_MOTION}/{name}/meanSkyOffset" for name, out in (("msTicCentroidOffsets", "ms_tic_centroid_offset_sigma"), ("msControlCentroidOffsets", "ms_control_centroid_offset_sigma"))}
    core, halo = f"{_GHOST}/coreApertureCorrelationStatistic", f"{_GHOST}/haloApertureCorrelationStatistic"
    # A higher-order function keeps these columns out of whole-stage code, where all of them make one method that is too long for the JVM to compile.
    images = F.filter(p["differenceImageResults"], lambda x: F.lit(True))
    return {
        "planet_number": _number(p),
        "tce_toi_id": _text(p["_toiId"]),
        "toi_correlation": to_double(p["_toiCorrelation"]),
        "detrend_filter_length": to_long(p["_detrendFilterLength"]),
        "suspected_eclipsing_binary": to_bool(_text(p[f"{candidate}_suspectedEclipsingBinary"])),
        "max_single_event_sigma": number(candidate, "maxSingleEventSigma"),
        "max_multiple_event_sigma": number(candidate, "maxMultipleEventSigma"),
        "robust_statistic": number(candidate, "robustStatistic"),
        "model_chi_square_2": number(candidate, "modelChiSquare2"),
        "model_chi_square_dof_2": number(candidate, "modelChiSquareDof2"),
        "model_chi_square_gof": number(candidate, "modelChiSquareGof"),
        "model_chi_square_gof_dof": number(candidate, "modelChiSquareGofDof"),
        "weak_secondary_mes_mad": number(weak, "mesMad"),
        "weak_secondary_robust_statistic": number(weak, "robustStatistic"),
        "full_convergence": to_bool(_text(p[f"{fit}_fullConvergence"])),
        "model_chi_square": number(fit, "modelChiSquare"),
        "model_degrees_of_freedom": number(fit, "modelDegreesOfFreedom"),
        "model_fit_snr": number(fit, "modelFitSnr"),
        "transit_model_name": _text(p[f"{fit}_transitModelName"]),
        **{out: number(name, "value") for name, out in MODEL_PARAMETERS.items()},
        **{f"{out}_err": number(name, "uncertainty") for name, out in MODEL_PARAMETERS.items()},
        "odd_even_depth_statistic": number(odd_even, "value"),
        "odd_even_depth_significance": number(odd_even, "significance"),
        "bootstrap_significance": number("bootstrapResults", "significance"),
        **{out: over(number(path, "value"), number(path, "uncertainty")) for out, path in sky.items()},
        "ghost_core_correlation": number(core, "value"),
        "ghost_core_correlation_significance": number(core, "significance"),
        "ghost_halo_correlation": number(halo, "value"),
        "ghost_halo_correlation_significance": number(halo, "significance"),
        "sector": to_long(F.try_element_at(images, F.lit(-1))).cast("int"),
        "n_difference_images": F.size(images),
    }


@dataclass
class Parsed:
    """signals: one row per signal; file_errors: files that are no report; rejects: signals without a number; all from `files`, parsed."""

    files: DataFrame
    signals: DataFrame
    file_errors: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """One row: files_total, files_ok, files_failed, tces_extracted."""
        of_file = self.files.select("error_type", F.when(F.col("error_type").isNull(), F.filter("r.planetResults", lambda p: to_long(p["_planetNumber"]).isNotNull())).alias("p"))
        failed = F.col("error_type").isNotNull()
        return of_file.agg(F.count(F.lit(1)).alias("files_total"), F.count_if(~failed).alias("files_ok"), F.count_if(failed).alias("files_failed"), F.coalesce(F.sum(F.size(F.coalesce("p", F.array()))), F.lit(0)).cast("long").alias("tces_extracted"))


#: Walks the prolog (blanks, comments, instructions, a document type) and stops at the first element: no step is
#: tried twice, and nothing behind that element is read.
_ROOT_NAME = r"^(?>[\s\uFEFF]+|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!DOCTYPE[^>]*>)*+<(?:[\w.-]+:)?([\w.-]+)[\s/>]"


def scan_reports(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """(path, value): every report file below a folder, whole."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")


def _files(texts: DataFrame, target: Layout, signal: Layout, text_col: str, path_col: str) -> DataFrame:
    """(path, _root, r, error_type, message): each text parsed by its layouts. `r` is null where a text isn't well-formed; that its root is a report's is told by the first tag."""
    named = texts.select(F.col(path_col).alias("path"), F.regexp_extract(text_col, _ROOT_NAME, 1).alias("_root"), F.col(text_col).alias("value"))
    error = F.when(F.col("r").isNull() | (F.col("_root") == ""), "ParseError").when(F.col("_root") != ROOT, "ValueError")
    message = F.when(F.col("error_type") == "ValueError", F.concat(F.lit("unexpected root element "), F.col("_root"))).when(F.col("error_type").isNotNull(), "not well-formed")
    files = parsed(named, "value", target, "planetResults", signal)
    return files.withColumn("error_type", error).withColumn("message", message)


def _number(p: Column) -> Column:
    return to_long(p["_planetNumber"]).cast("int")


_NO_NUMBER = "planetNumber is missing or no integer"


def parse_reports(texts: DataFrame, *, text_col: str = "value", path_col: str = "path", bit_order: str = "right") -> Parsed:
    """Parse report texts. A file that is no report, or a signal without a number, is set aside and stops nothing.

    A report without signals gives no rows. Where errors alone are asked for, `parse_errors` is cheaper.
    """
    files = _files(texts, TARGET, SIGNAL, text_col, path_col)
    errors = files.filter("error_type is not null").select(F.current_timestamp().alias("timestamp"), F.lit("file").alias("level"), "path", "error_type", "message")
    # What holds for the target is worked out once a file, in a step below the generator of its signals.
    target, signal = target_columns(F.col("r"), bit_order), signal_columns(F.col("p"))
    each = files.filter("error_type is null").select(F.regexp_extract("path", "[^/]*$", 0).alias("xml_filename"), F.col("path").alias("_path"), *[c.alias(f"_t_{n}") for n, c in target.items()], F.col("r.planetResults").alias("_signals"))
    rows = each.withColumn("p", F.explode("_signals")).select("xml_filename", "_path", *[c.alias(n) for n, c in ({n: F.col(f"_t_{n}") for n in target} | signal).items()])
    rejects = rows.filter("planet_number is null").select(F.current_timestamp().alias("timestamp"), F.lit("tce").alias("level"), F.col("_path").alias("path"), "tic_id", F.lit("ValueError").alias("error_type"), F.lit(_NO_NUMBER).alias("message"))
    return Parsed(files, rows.filter("planet_number is not null").drop("_path"), errors, rejects)


def parse_errors(texts: DataFrame, *, text_col: str = "value", path_col: str = "path") -> DataFrame:
    """(timestamp, level, path, error_type, message, tic_id): the file errors and rejects of `parse_reports`, from one pass that reads nothing else of a report."""
    files = _files(texts, TARGET_ID, SIGNAL_NUMBER, text_col, path_col)
    entry = lambda level, kind, message, tic_id: F.struct(F.lit(level).alias("level"), kind.alias("error_type"), message.alias("message"), tic_id.alias("tic_id"))
    of_file = F.array(entry("file", F.col("error_type"), F.col("message"), F.lit(None).cast("long")))
    of_signals = F.transform(F.filter("r.planetResults", lambda p: _number(p).isNull()), lambda p: entry("tce", F.lit("ValueError"), F.lit(_NO_NUMBER), to_long(F.col("r._ticId"))))
    each = files.select("path", F.explode(F.when(F.col("error_type").isNotNull(), of_file).otherwise(of_signals)).alias("e"))
    return each.select(F.current_timestamp().alias("timestamp"), "e.level", "path", "e.error_type", "e.message", "e.tic_id")


def write_signals(parsed: Parsed, path: str, errors_path: str, parser_version: str, observed: dict[str, int] | None = None) -> bool:
    """Write signals by sector (replacing only the sectors present) and errors as JSON lines; nothing if there are no rows.

    Files are parsed once and kept on disk for the run. Returns False if there were files and every one
    failed; `observed` (a dictionary) receives files_total, files_ok, files_failed and rows written.
    """
    parsed.files.persist(StorageLevel.DISK_ONLY)
    try:
        return _write(parsed, path, errors_path, parser_version, {} if observed is None else observed)
    finally:
        parsed.files.unpersist()


def _write(parsed: Parsed, path: str, errors_path: str, parser_version: str, observed: dict[str, int]) -> bool:
    of_files, of_rows = Observation("files"), Observation("signals")
    watched = parsed.files.observe(of_files, F.count(F.lit(1)).alias("files_total"), F.count_if(F.col("error_type").isNull()).alias("files_ok"))
    watched.select("path").write.format("noop").mode("overwrite").save()
    signals = parsed.signals
    stamps = {"parser_version": F.lit(parser_version), "parsed_at": F.current_timestamp()}
    signals = signals.withColumns({k: v for k, v in stamps.items() if k not in signals.columns})
    if not signals.isEmpty():
        signals = signals.observe(of_rows, F.count(F.lit(1)).alias("rows"))
        signals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sector").parquet(path)
        observed["rows"] = of_rows.get["rows"]
    errors = parsed.file_errors.unionByName(parsed.rejects, allowMissingColumns=True)
    if not errors.isEmpty():
        errors.write.mode("append").json(errors_path)
    total, good = of_files.get["files_total"], of_files.get["files_ok"]
    observed |= {"files_total": total, "files_ok": good, "files_failed": total - good, "rows": observed.get("rows", 0)}
    return total == 0 or good > 0
