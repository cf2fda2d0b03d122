"""Alerts rendered as XML, in batch or in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the alert format.
NAMESPACE = "urn:oasis:names:tc:emergency:cap:1.2"


def alert_xml(alerts: DataFrame, sender: str, language: str = "en") -> DataFrame:
    """(identifier, xml) from identifier, sent, severity and urgency, with certainty, expires and area where there are such columns; text is escaped by the writer."""
    info = [F.lit(language).alias("language"), F.lit("Geo").alias("category"), F.lit("Mass movement").alias("event"), F.col("urgency"), F.col("severity"), (F.col("certainty") if "certainty" in alerts.columns else F.lit("Possible")).alias("certainty")]
    if "expires" in alerts.columns:
        info.append(F.col("expires"))
    info.append(F.concat(F.lit("Modelled mass movement, "), F.lower("severity"), F.lit(" severity, "), F.lower("urgency")).alias("headline"))
    if "area" in alerts.columns:
        info.append(F.struct(F.col("area").alias("areaDesc")).alias("area"))
    body = F.struct(F.lit(NAMESPACE).alias("_xmlns"), F.col("identifier"), F.lit(sender).alias("sender"), F.col("sent"), F.lit("Exercise").alias("status"), F.lit("Alert").alias("msgType"), F.lit("Restricted").alias("scope"), F.struct(*info).alias("info"))
    return alerts.select("identifier", F.to_xml(body, {"rowTag": "alert"}).alias("xml"))
