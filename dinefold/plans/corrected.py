"""Reports over groups whose guests were corrected by visit feedback.

Totals, per-capita values, bands, anomalies and the index follow the corrected guests.
"""

from __future__ import annotations

from dinefold.operators import anomalies as A
from dinefold.operators import groups as G
from dinefold.operators import reports as RP
from dinefold.operators import visits as V
from dinefold.plans.catalog import query
from dinefold.plans.merge import merged_and_groups
from dinefold.plans.out import plain
from dinefold.plans.prelude import CTES, oracle
from dinefold.plans.reports import buckets_sql, overview_sql
from dinefold.plans.visits import linked
from dinefold.session import stored

CTES["fixed"] = """
  select * replace (cast(((2 * cast(revenue * 100 as bigint) + guests) // (2 * guests)) * 0.01 as decimal(18,2)) as per_capita) from corrected"""
for _name, _source in (("banded", "kept"), ("anom", "kept"), ("found", "anom")):
    CTES[f"{_name}_fixed"] = CTES[_name].replace(f"from {_source}", "from fixed" if _source == "kept" else f"from {_source}_fixed")


def corrected(spark, sf):
    """Counted groups with corrected guests, written once."""
    merged, groups = merged_and_groups(spark, sf)
    return stored(V.guest_correction(G.kept(groups), linked(spark, sf, merged)), "corrected")


@query("corrected_overview", oracle(overview_sql("store", "fixed")))
def corrected_overview(spark, sf):
    return plain(RP.overview(corrected(spark, sf), ["store"]))


@query("corrected_price_buckets", oracle(buckets_sql("store", "store").replace("banded", "banded_fixed")))
def corrected_price_buckets(spark, sf):
    return RP.price_buckets(corrected(spark, sf), ["store"])


@query("corrected_anomalies", oracle("select group_id, rule, message from found_fixed"))
def corrected_anomalies(spark, sf):
    return A.detect_anomalies(corrected(spark, sf)).select("group_id", "rule", "message")


@query(
    "corrected_index",
    oracle(
        """select group_id, store, table_name, pos_guests, guests, guests_corrected, cast(per_capita as double) as per_capita,
          per_capita < case when store = '保利店' then 40 else 100 end as red_line from fixed"""
    ),
)
def corrected_index(spark, sf):
    groups = A.red_line(corrected(spark, sf))
    return plain(groups.select("group_id", "store", "table_name", "pos_guests", "guests", "guests_corrected", "per_capita", "red_line"))
