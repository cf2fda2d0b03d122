"""Text, hash and identifier expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Meta names that give a title, best first; the entities that titles hold.
TITLE_NAMES = ("citation_title", "dc.title", "og:title")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def collapsed(x: Column) -> Column:
    """White space run together and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def unescaped(x: Column) -> Column:
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


#: The first meta element of these names in the document, with its attributes in this order; then in the other; then the title element.
_NAMES = "(?:" + "|".join(n.replace(".", r"\.") for n in TITLE_NAMES) + ")"
TITLES = (
    rf"""(?is)<meta\s+[^>]*?(?:name|property)\s*=\s*["']{_NAMES}["'][^>]*?content\s*=\s*["']([^"']+)["']""",
    rf"""(?is)<meta\s+[^>]*?content\s*=\s*["']([^"']+)["'][^>]*?(?:name|property)\s*=\s*["']{_NAMES}["']""",
    r"(?is)<title[^>]*>(.*?)</title>",
)


def html_title(page: Column, decoded=unescaped) -> Column:
    """The first of the meta titles, in either order of attributes, or of the title element, that isn't blank. ``decoded`` resolves entities."""
    return F.coalesce(*[collapsed(decoded(F.regexp_extract(page, pattern, 1))) for pattern in TITLES])


@pandas_udf(StringType())
def all_entities(x: pd.Series) -> pd.Series:
    """Every named and numeric entity resolved; titles are short, so only they are sent."""
    return x.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)


def document_title(content: Column, content_type: Column) -> Column:
    """Title of a page, or of a JSON document: its message's title or its own, of a list the first; null for other kinds."""
    kind = media_type(content_type)
    listed = [F.get_json_object(content, f"$.{at}title[0]") for at in ("message.", "")]
    plain = [F.get_json_object(content, f"$.{at}title") for at in ("message.", "")]
    has_message = F.get_json_object(content, "$.message").isNotNull()
    of = lambda k: F.when(plain[k].startswith("["), listed[k]).otherwise(plain[k])
    json_title = F.when(has_message, of(0)).otherwise(of(1))
    page = F.coalesce(*[F.nullif(collapsed(F.regexp_extract(content, pattern, 1)), F.lit("")) for pattern in TITLES])
    found = F.when(kind.isin("text/html", "application/xhtml+xml"), page).when(kind == "application/json", json_title)
    return collapsed(all_entities(found))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def sncl_parts(key: Column) -> Column:
    """Network, station, location and channel; an empty location is legal."""
    parts = F.split(key, r"\.", -1)
    return F.struct(*[parts[k].alias(n) for k, n in enumerate(("network", "station", "location", "channel"))])


def normalised_reason(reason: Column) -> Column:
    """Numbers become N; what follows a bracket goes."""
    return F.trim(F.regexp_replace(F.split_part(reason, F.lit("("), F.lit(1)), r"-?\d+(?:\.\d+)?", "N"))


def set_hash(ids: Column) -> Column:
    """Aggregate: SHA-256 of the sorted distinct ids, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), 256)


def stamp(ts: Column) -> Column:
    """Time without fraction and with an explicit offset."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def identifier(key: Column, ts: Column) -> Column:
    """An alert identifier: characters that the format forbids become hyphens."""
    return F.concat(F.translate(key, " ,<&", "----"), F.lit("-"), F.date_format(ts, "yyyyMMdd'T'HHmmss"))


def is_volatile(key: Column) -> Column:
    """Keys that differ between equal runs."""
    return key.isin("run_id", "host", "duration_s") | key.endswith("_utc") | key.endswith("_at")


def forbidden_tokens(name: Column, tokens: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(name), t))


CROSSREF = "status string, message struct<DOI string, title array<string>, author array<struct<family string, given string, name string>>, publisher string, `container-title` array<string>, `published-print` struct<`date-parts` array<array<int>>>, `published-online` struct<`date-parts` array<array<int>>>, published struct<`date-parts` array<array<int>>>, issued struct<`date-parts` array<array<int>>>, created struct<`date-parts` array<array<int>>>>"


def crossref(doi: Column, status: Column, body: Column) -> Column:
    """Struct of a work record; ``problem`` says why a response isn't one: not found, no JSON, no record, or that of another work."""
    doc = F.from_json(body, CROSSREF)
    m = doc["message"]
    year = F.coalesce(*[F.get(F.get(m[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "published", "issued", "created")])
    person = lambda p: F.coalesce(F.when(F.coalesce(p["family"], F.lit("")) != "", F.concat_ws(", ", p["family"], F.nullif(p["given"], F.lit("")))), p["name"])
    problem = (
        F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(F.get_json_object(body, "$").isNull(), "non-JSON").when(m.isNull() | ~doc["status"].eqNullSafe(F.lit("ok")), "no work record")
        .when(F.lower(F.coalesce(m["DOI"], F.lit(""))) != F.lower(doi), "another DOI")
    )
    return F.struct(
        m["DOI"].alias("doi"), collapsed(unescaped(F.get(m["title"], F.lit(0)))).alias("title"), F.array_compact(F.transform(m["author"], person)).alias("authors"), year.alias("year"), m["publisher"].alias("publisher"),
        F.get(m["container-title"], F.lit(0)).alias("container"), F.sha2(body, 256).alias("sha256"), problem.alias("problem"),
    )
