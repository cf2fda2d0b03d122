"""Rule sets of records: names and conditions that a broken record meets, for ``contracts.violations``.

A rule that can't be decided, as a field is null, doesn't hold; fields that must be there have rules
of their own. Fields are named as the records name them; nested lists stay arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, Column]

# Where synthetic files live and what describes a folder; kinds of sources that support a best value
# or a single force; status and provenance of a placeholder.
SYNTHETIC_FOLDER = "tests/fixtures/synthetic/"
FOLDER_NOTES = ("FIXTURES.md", ".gitkeep", "README.md", "manifest.json")
BEST_KINDS = ("peer_reviewed", "usgs_comcat", "agency_official", "dataset")
FORCE_KINDS = ("peer_reviewed", "usgs_comcat")
SYNTHETIC = "synthetic"


def _c(name: str) -> Column:
    return F.col(name)


def ledger_entry() -> Rules:
    """A ledger row: what a fetched file must state, where synthetic ones may live, order of times and of the box."""
    w, s, e, n = (F.get("bbox", F.lit(k)) for k in range(4))
    made, fetched = _c("provenance") == SYNTHETIC, _c("status") == "fetched"
    return {
        **{f"fetched without {x}": fetched & _c(x).isNull() for x in ("path", "sha256", "size_bytes", "retrieved_at")},
        "status synthetic, provenance not": (_c("status") == SYNTHETIC) & ~made,
        "provenance synthetic, status not": made & ~_c("status").isin(SYNTHETIC, "dry_run"),
        "synthetic outside its folder": made & ~_c("path").startswith(SYNTHETIC_FOLDER),
        "synthetic without notes": made & (F.coalesce("notes", F.lit("")) == ""),
        "synthetic under data": made & _c("path").startswith("data/"),
        "ends before it starts": _c("time_end") < _c("time_start"),
        "box out of order": ~((w >= -180) & (w <= e) & (e <= 180) & (s >= -90) & (s <= n) & (n <= 90)),
    }


def ledger_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Files against the ledger: (path, rule). entries: path, status, provenance, sha256, size_bytes, notes; files: path, sha256, size_bytes.

    entries holds the latest row of each path. Rows that should have bytes are hashed again; rows that
    shouldn't have any must have no file; files in the synthetic folder must be recorded.
    """
    held = files.select("path", F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    both = entries.where("path is not null").join(held, "path", "full")
    listed, file = _c("status").isNotNull(), _c("_sha").isNotNull()
    kept = _c("status").isin("fetched", "listed", SYNTHETIC)
    made = _c("provenance") == SYNTHETIC
    inside = _c("path").startswith(SYNTHETIC_FOLDER)
    rules = {
        "file is missing": kept & ~file,
        "no hash or size recorded": kept & file & (_c("sha256").isNull() | _c("size_bytes").isNull()),
        "bytes differ": kept & file & ((_c("sha256") != _c("_sha")) | (_c("size_bytes") != _c("_size"))),
        "file of a row without one": _c("status").isin("not_fetched", "requested", "failed") & file,
        "real row in the synthetic folder": listed & inside & ~made,
        "synthetic row under data": _c("path").startswith("data/") & (made | (_c("status") == SYNTHETIC)),
        "synthetic row not labelled": made & (~F.contains(F.lower(F.coalesce("notes", F.lit(""))), F.lit(SYNTHETIC)) | (_c("status") != SYNTHETIC)),
        "file not recorded": file & inside & ~(listed & made) & ~F.element_at(F.split("path", "/"), -1).isin(*FOLDER_NOTES),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return both.select("path", F.explode(found).alias("rule"))


def trace() -> Rules:
    """A chunk of samples: its end within a sample of what start, count and rate give; hash and length of its bytes."""
    expected = _c("start_us") + (_c("npts") - 1) * 1e6 / _c("rate_hz")
    return {
        "end doesn't follow": F.abs(_c("end_us") - expected) > 1e6 / _c("rate_hz"),
        "hash differs": F.sha2("data", 256) != _c("data_sha256"),
        "length differs": (_c("encoding") == "float32le") & (F.octet_length("data") != 4 * _c("npts")),
    }


def detection() -> Rules:
    return {
        "window ends before it starts": _c("window_end") < _c("window_start"),
        "detected outside the window": ~_c("detected_at").between(_c("window_start"), _c("window_end")),
        "probability without calibration": _c("probability").isNotNull() & (F.coalesce("calibration", F.lit("")) == ""),
        "stub with a location": _c("is_stub") & _c("located"),
        "class probability outside 0 to 1": F.exists(F.map_values("class_probabilities"), lambda p: (p < 0) | (p > 1)),
    }


def watch_state() -> Rules:
    """Insufficient data, no score and a reason go together."""
    blind = _c("tier") == "insufficient_data"
    return {
        "insufficient with a score": blind & _c("score").isNotNull(),
        "tier without a score": ~blind & _c("score").isNull(),
        "insufficient without a reason": blind & _c("reason").isNull(),
        "tier with a reason": ~blind & _c("reason").isNotNull(),
    }


def asset_loss() -> Rules:
    """Undetermined isn't zero: it names what is lacking and holds no loss."""
    known = _c("determined")
    return {
        "determined and blocked": known & _c("blocked_by").isNotNull(),
        "determined without a loss": known & _c("expected_loss").isNull(),
        "undetermined without a reason": ~known & _c("blocked_by").isNull(),
        "undetermined with a loss": ~known & (_c("expected_loss").isNotNull() | _c("avoided").isNotNull()),
    }


def replay_report() -> Rules:
    """fixtures: array of structs with ``provenance``."""
    return {
        "finished before it started": _c("finished_at") < _c("started_at"),
        "wall clock at another speed": _c("wall_clock_valid") & (_c("speed") != 1.0),
        "synthetic flag differs": _c("contains_synthetic") != F.exists("fixtures", lambda f: f["provenance"] == SYNTHETIC),
        "failed without an error": (_c("status") == "failed") & (F.coalesce("error", F.lit("")) == ""),
    }


def ring(positions: str = "ring") -> Rules:
    """A linear ring, an array of (lon, lat): at least four positions, closed, in range."""
    at = _c(positions)
    return {
        "fewer than four positions": F.size(at) < 4,
        "not closed": ~F.get(at, F.lit(0)).eqNullSafe(F.get(at, F.size(at) - 1)),
        "position out of range": F.exists(at, lambda p: (F.abs(p["lon"]) > 180) | (F.abs(p["lat"]) > 90)),
    }


def time_axis(steps: str = "steps", zone: str = "zone") -> Rules:
    """An axis, an array in the order of the file: strictly increasing, in UTC."""
    at = _c(steps)
    return {
        "no time axis": at.isNull(),
        "not strictly increasing": F.exists(F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: b <= a), lambda x: F.coalesce(x, F.lit(False))),
        "not in UTC": F.coalesce(zone, F.lit("UTC")) != "UTC",
    }


def grid_spec() -> Rules:
    """Edges on multiples of the resolution, and extents that width and height give."""
    r = _c("resolution_m")
    off = lambda x: F.abs(x - F.round(x / r) * r)
    return {
        "x_min off the lattice": off(_c("x_min")) > 1e-6 * r,
        "y_min off the lattice": off(_c("y_min")) > 1e-6 * r,
        "x_max doesn't follow": F.abs(_c("x_min") + _c("width") * r - _c("x_max")) > 1e-6 * r,
        "y_max doesn't follow": F.abs(_c("y_min") + _c("height") * r - _c("y_max")) > 1e-6 * r,
    }


# Event records: sources array<struct<id, kind, claims array<string>>>, ranges map<string, struct<low, high, best, refs>>
# (null where a range is unknown), flags map<string, boolean>, notes map<string, string>, seismic and related
# (array of) struct<usgs_id, single_force, refs>, precursors array<struct<lead_days, description>>, impacts array<string>.


def _kinds(refs: Column, kinds: tuple[str, ...]) -> Column:
    """Whether one of the referenced sources is of such a kind."""
    return F.exists("sources", lambda s: F.array_contains(refs, s["id"]) & s["kind"].isin(*kinds))


def best_without_source() -> Column:
    """Paths of ranges with a best value and no source that qualifies for one."""
    best = F.filter(F.map_entries("ranges"), lambda r: r["value"]["best"].isNotNull() & ~_kinds(r["value"]["refs"], BEST_KINDS))
    return F.transform(best, lambda r: r["key"])


def known_ranges() -> Column:
    """Path and interval of every range that is known."""
    return F.filter(F.map_entries("ranges"), lambda r: r["value"].isNotNull())


def event_sources() -> Rules:
    """References resolve, claims name fields, every range is claimed, best values have sources that qualify."""
    ids, claims = F.transform("sources", lambda s: s["id"]), F.flatten(F.transform("sources", lambda s: s["claims"]))
    refs = F.flatten(F.transform(known_ranges(), lambda r: r["value"]["refs"]))
    fields = F.concat(F.map_keys("ranges"), F.map_keys("flags"), F.array(F.lit("seismic")))
    return {
        "source id repeated": F.size(ids) > F.size(F.array_distinct(ids)),
        "reference to no source": F.size(F.array_except(refs, ids)) > 0,
        "claim of no field": F.size(F.array_except(claims, fields)) > 0,
        "range without a claim": F.size(F.array_except(F.transform(known_ranges(), lambda r: r["key"]), claims)) > 0,
        "best without a source of its kind": F.size(best_without_source()) > 0,
    }


def event_notes() -> Rules:
    """What is null has a note, or its list item a description; notes name null fields only."""
    unknown = lambda name: F.transform(F.filter(F.map_entries(name), lambda r: r["value"].isNull()), lambda r: r["key"])
    null = F.concat(unknown("ranges"), unknown("flags"), F.when(_c("seismic").isNull(), F.array(F.lit("seismic"))).otherwise(F.array().cast("array<string>")))
    items = F.transform(F.filter(F.transform("precursors", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"]["lead_days"].isNull()), lambda x: F.struct(F.format_string("precursors[%d].lead_days", x["i"]).alias("path"), x["p"]["description"].alias("said")))
    noted = F.coalesce(F.map_keys("notes"), F.array().cast("array<string>"))
    return {
        "null without a note": F.size(F.array_except(null, noted)) > 0,
        "null item without a description": F.exists(items, lambda x: (F.coalesce(x["said"], F.lit("")) == "") & ~F.array_contains(noted, x["path"])),
        "note of no null field": F.size(F.array_except(noted, F.concat(null, F.transform(items, lambda x: x["path"])))) > 0,
    }


def event_roles() -> Rules:
    """Roles and failure types that imply each other, and the evidence that a role needs."""
    quake, glof = _c("failure_type") == "co_seismic_avalanche", _c("failure_type") == "moraine_collapse_glof"
    evacuated = _c("role") == "evacuation_counterfactual"
    return {
        "negative control is a moraine collapse": (_c("role") == "negative_control") != glof,
        "co-seismic reference is a co-seismic avalanche": (_c("role") == "co_seismic_reference") != quake,
        "co-seismic without its quake": quake & _c("seismic.usgs_id").isNull(),
        "evacuation without lead time": evacuated & ~F.exists("precursors", lambda p: p["lead_days"].isNotNull()),
        "evacuation without an evacuation": evacuated & ~F.array_contains("impacts", "evacuated"),
    }


def event_seismic() -> Rules:
    every = F.array_compact(F.concat(F.array("seismic"), "related"))
    ids = F.array_compact(F.transform(every, lambda s: s["usgs_id"]))
    return {
        "single force without a source of its kind": F.exists(every, lambda s: F.coalesce(s["single_force"], F.lit(False)) & ~_kinds(s["refs"], FORCE_KINDS)),
        "quake id repeated": F.size(ids) > F.size(F.array_distinct(ids)),
    }


def event_record() -> Rules:
    return {**event_sources(), **event_notes(), **event_roles(), **event_seismic()}


def library(events: DataFrame, ledger: DataFrame, transects: DataFrame, roles: dict[str, int]) -> DataFrame:
    """(event_id, check) of a record library: ranges without reference, sources not in the ledger, unknown transects, roles held too seldom.

    events: as for ``event_record``, with source hashes and ``transects array<string>``; ledger: sha256; transects: transect.
    Rows of missing roles have the role as event_id. Sources and transects are looked up by anti joins.
    """
    bare = events.where(F.exists(known_ranges(), lambda r: F.size(r["value"]["refs"]) == 0)).select("event_id", F.lit("range without a reference").alias("check"))
    hashes = events.select("event_id", F.explode("sources").alias("s")).select("event_id", F.col("s.sha256").alias("sha256")).distinct()
    unknown = hashes.join(ledger.select("sha256").distinct(), "sha256", "left_anti").select("event_id", F.lit("source not in the ledger").alias("check")).distinct()
    asked = events.select("event_id", F.explode("transects").alias("transect")).distinct()
    lost = asked.join(transects.select("transect").distinct(), "transect", "left_anti").select("event_id", F.lit("unknown transect").alias("check")).distinct()
    counts = [F.struct(F.lit(role).alias("event_id"), (F.count_if(F.col("role") == role) < least).alias("short")) for role, least in roles.items()]
    short = events.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).where("x.short").select("x.event_id", F.lit("role held too seldom").alias("check"))
    return bare.unionAll(unknown).unionAll(lost).unionAll(short)


def sealed(config_json: Column, sealed_json: Column) -> tuple[Column, Column]:
    """Whether a configuration still has the seal's hash, and the sections (keys, sorted) that changed. Both are maps by section."""
    now, then = (F.array_sort(F.map_entries(x)) for x in (config_json, sealed_json))
    changed = F.filter(F.array_sort(F.map_keys(config_json)), lambda k: ~F.element_at(config_json, k).eqNullSafe(F.try_element_at(sealed_json, k)))
    return F.sha2(F.to_json(now), 256) == F.sha2(F.to_json(then), 256), changed
