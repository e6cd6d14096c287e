"""Views of the driver tables in this library's input shapes.

Each view is one SQL text that Spark and the comparison engine both read, so a query and its
counterpart start from the same rows. They stand in for catalog dumps and grids, and grow
with the driver tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    """SQL texts; ``duck`` picks the few spellings that differ."""

    def __init__(self, duck: bool) -> None:
        self.duck = duck

    # -- spelling -----------------------------------------------------------------

    def t(self, name: str) -> str:
        return name if self.duck else "{" + name + "}"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) // {b})" if self.duck else f"(({a}) div {b})"

    def bit(self, a: str, i: int) -> str:
        return f"({self.div(a, 2 ** i)} % 2 = 1)"

    def each(self, n: int) -> str:
        if self.duck:
            return f"CROSS JOIN range({n}) x(k)"
        return f"LATERAL VIEW explode(sequence(0L, {n - 1}L)) x AS k"

    def stamp(self, y: str, m: str, d: str, h: str = "0", mi: str = "0") -> str:
        fn = "make_timestamp" if self.duck else "make_timestamp_ntz"
        return f"{fn}({y}, {m}, {d}, {h}, {mi}, 0)"

    def plus_days(self, ts: str, n: str) -> str:
        if self.duck:
            return f"({ts} + to_days(CAST({n} AS INTEGER)))"
        return f"timestampadd(DAY, CAST({n} AS INT), {ts})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)" if self.duck else f"CAST({x} AS STRING)"

    @property
    def json_open(self) -> str:
        return "{" if self.duck else "{{"

    @property
    def json_close(self) -> str:
        return "}" if self.duck else "}}"

    # -- grids ----------------------------------------------------------------------

    def grid_events(self, lat: str = "user_id % 6", lon: str = "event_id % 8") -> str:
        hour = self.div("hour(ts)", 6)
        six = self.stamp("year(ts)", "month(ts)", "day(ts)", f"CAST({hour} * 6 AS INTEGER)")
        return f"""(SELECT time, lat_idx, lon_idx,
            CAST(-75 + 30 * lat_idx AS DOUBLE) AS lat, CAST(-157.5 + 45 * lon_idx AS DOUBLE) AS lon,
            n, v_sum, CAST(v_sum AS DOUBLE) / n AS value_mean
          FROM (SELECT {six} AS time, {lat} AS lat_idx, {lon} AS lon_idx,
              count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v_sum
            FROM {self.t('events')} GROUP BY 1, 2, 3))"""

    def grid_a(self) -> str:
        """All events on the west part of the axes; the east part is the other grid's."""
        return self.grid_events(lon="event_id % 6")

    def grid_b(self) -> str:
        return self.grid_events(lat="1 + user_id % 5", lon="3 + event_id % 5")

    def readings(self) -> str:
        """One stored value per event at its own cell and instant."""
        return f"""(SELECT event_id, ts AS time, user_id % 6 AS lat_idx, event_id % 8 AS lon_idx,
            CAST(round(value * 100) AS BIGINT) AS stored, event_type AS variable
          FROM {self.t('events')})"""

    def wide_grid(self) -> str:
        """Half-degree cells of the whole globe by day: one for each part, supplier and ship date."""
        return f"""(SELECT CAST(l_shipdate AS {'TIMESTAMP' if self.duck else 'TIMESTAMP_NTZ'}) AS time, lat_idx, lon_idx,
            CAST(-89.75 + 0.5 * lat_idx AS DOUBLE) AS lat, CAST(-179.75 + 0.5 * lon_idx AS DOUBLE) AS lon, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount
          FROM (SELECT l_shipdate, (l_suppkey * 7919 + l_orderkey * 31) % 360 AS lat_idx, (l_partkey * 104729 + l_orderkey * 17) % 720 AS lon_idx, l_quantity
            FROM {self.t('lineitem')}) GROUP BY 1, 2, 3)"""

    def swath(self) -> str:
        """Cells that lie on no axes: one per customer, with a value for each of its orders' days."""
        return f"""(SELECT c_custkey AS cell_id, CAST(-90 + (c_custkey * 7919) % 18001 * 0.01 AS DOUBLE) AS lat,
            CAST(-180 + (c_custkey * 104729) % 36000 * 0.01 AS DOUBLE) AS lon,
            CAST(o_orderdate AS {'TIMESTAMP' if self.duck else 'TIMESTAMP_NTZ'}) AS time, CAST(count(*) AS BIGINT) AS amount
          FROM {self.t('customer')} JOIN {self.t('orders')} ON c_custkey = o_custkey GROUP BY c_custkey, o_orderdate)"""

    def swath_points(self) -> str:
        """Points all over the globe, some at the poles and on the antimeridian."""
        k = "s_suppkey"
        start = "TIMESTAMP '1995-01-01'" if self.duck else "TIMESTAMP_NTZ '1995-01-01'"
        return f"""(SELECT {k} AS point_id, CAST(CASE {k} % 9 WHEN 0 THEN 90 WHEN 1 THEN -90 ELSE -89 + ({k} * 31) % 178 END AS DOUBLE) AS lat,
            CAST(CASE {k} % 5 WHEN 0 THEN 180 WHEN 1 THEN -180 ELSE -179 + ({k} * 53) % 358 END AS DOUBLE) AS lon,
            {self.plus_days(start, f'{k} % 200')} AS t0, {self.plus_days(start, f'{k} % 200 + 500')} AS t1
          FROM {self.t('supplier')})"""

    # -- catalog ----------------------------------------------------------------------

    def collections(self) -> str:
        k = "c_custkey"
        return f"""(SELECT {k} AS k, 'C' || {k} AS concept_id, 'PROV' || (c_nationkey % 5) AS provider_id,
            {k} % 7 AS revision_id, 'SN' || ({k} % 97) AS short_name, {self.text(f'{k} % 4')} AS version,
            c_name || ' ' || c_mktsegment AS entry_title, 'Daily ' || lower(c_mktsegment) || ' fields' AS abstract,
            CASE {k} % 5 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '4' WHEN 3 THEN '1B' END AS processing_level,
            CASE WHEN {k} % 3 = 0 THEN 'netCDF-4' WHEN {k} % 3 = 1 THEN 'HDF5' END AS fmt1,
            CASE WHEN {k} % 4 < 2 THEN 'netCDF-4' ELSE '' END AS fmt2,
            CASE {k} % 4 WHEN 0 THEN 'us-west-2' WHEN 1 THEN ' US-WEST-2 ' WHEN 2 THEN 'us-east-1' END AS direct_region,
            CASE WHEN {k} % 3 = 0 THEN 'ACTIVE' WHEN {k} % 3 = 1 THEN 'COMPLETE' END AS collection_progress,
            CASE WHEN {k} % 4 = 0 THEN false WHEN {k} % 4 = 1 THEN true END AS standard_product,
            CASE WHEN {k} % 6 = 0 THEN 'For ' || c_mktsegment END AS purpose,
            CASE WHEN {k} % 5 < 3 THEN '10.5067/' || {k} END AS doi,
            {k} % 3 AS extent_kind, {k} % 6 AS n_citing,
            CAST(-180 + {k} % 90 AS DOUBLE) AS w, CAST(-90 + {k} % 40 AS DOUBLE) AS s,
            CAST(180 - {k} % 45 AS DOUBLE) AS e, CAST(90 - {k} % 20 AS DOUBLE) AS n,
            10 * (1 + {k} % 18) AS n_lat, CASE WHEN {k} % 11 = 0 THEN 0 ELSE 20 * (1 + {k} % 18) END AS n_lon,
            {self.plus_days("TIMESTAMP '1995-01-01'" if self.duck else "TIMESTAMP_NTZ '1995-01-01'", f'{k} % 1000')} AS time_start,
            {self.plus_days("TIMESTAMP '1998-01-01'" if self.duck else "TIMESTAMP_NTZ '1998-01-01'", f'{k} % 1000')} AS time_end,
            {k} % 3 <> 1 AS has_granules
          FROM {self.t('customer')})"""

    def variables(self) -> str:
        """Up to six variables per collection: axes, time, data, and a repeated leaf name."""
        return f"""(SELECT collection_id, 'V' || k0 || '_' || pos AS concept_id, pos, k0, name, standard_name,
            units, scale, fill, d1, n1, d2, n2, d3, n3 FROM (
          SELECT 'C' || c_custkey AS collection_id, c_custkey AS k0, k AS pos,
            CASE k WHEN 0 THEN (CASE WHEN c_custkey % 3 = 1 THEN '/product/latitude' ELSE 'lat' END)
              WHEN 1 THEN (CASE WHEN c_custkey % 3 = 1 THEN '/product/longitude' ELSE 'lon' END)
              WHEN 2 THEN (CASE WHEN c_custkey % 3 = 1 THEN '/product/time' ELSE 'time' END)
              WHEN 3 THEN (CASE WHEN c_custkey % 3 = 1 THEN '/product/ndvi' ELSE 'ndvi' END)
              WHEN 4 THEN (CASE WHEN c_custkey % 3 = 1 THEN '/support/QA Flag' ELSE 'QA Flag' END)
              ELSE '/other/NDVI' END AS name,
            CASE WHEN k = 0 AND c_custkey % 2 = 0 THEN 'latitude' WHEN k = 2 THEN 'time' END AS standard_name,
            CASE WHEN k < 2 THEN 'degrees' WHEN k = 3 THEN '1' END AS units,
            CASE WHEN k = 3 THEN 0.01 END AS scale, CASE WHEN k >= 3 THEN -9999.0 END AS fill,
            CASE k WHEN 0 THEN (CASE WHEN c_custkey % 3 = 1 THEN 'latitude' ELSE 'lat' END)
              WHEN 1 THEN (CASE WHEN c_custkey % 3 = 1 THEN '/product/longitude' ELSE 'lon' END)
              WHEN 2 THEN 'time' WHEN 3 THEN 'time' WHEN 4 THEN 'band' ELSE 'cell' END AS d1,
            CASE k WHEN 0 THEN 10 * (1 + c_custkey % 18)
              WHEN 1 THEN CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 20 * (1 + c_custkey % 18) END
              WHEN 4 THEN CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 3 END ELSE 1 END AS n1,
            CASE WHEN k IN (3, 4) THEN (CASE WHEN c_custkey % 3 = 1 THEN 'latitude' ELSE 'lat' END) END AS d2,
            CASE WHEN k IN (3, 4) THEN 10 * (1 + c_custkey % 18) END AS n2,
            CASE WHEN k IN (3, 4) THEN (CASE WHEN c_custkey % 3 = 1 THEN 'longitude' ELSE 'lon' END) END AS d3,
            CASE WHEN k IN (3, 4) THEN 20 * (1 + c_custkey % 18) END AS n3
          FROM {self.t('customer')} {self.each(6)}
          WHERE (k <> 2 OR c_custkey % 2 = 0) AND (k <> 5 OR c_custkey % 7 = 0)))"""

    def services(self) -> str:
        """Zero to three services per collection with bit-pattern capabilities."""
        v = "(c_custkey * 7 + k * 13)"
        flags = ", ".join(
            f"{self.bit(v, i)} AS {name}"
            for i, name in enumerate(("bbox", "variable", "temporal", "shape", "dimension", "reproject"))
        )
        return f"""(SELECT 'C' || c_custkey AS collection_id, k AS pos, 'svc/' || (c_custkey % 9) || '-' || k AS service_name,
            'S' || (c_custkey * 3 + k) AS service_id, {flags}, {self.bit(v, 6)} AS concatenate,
            c_custkey % 2 = 0 OR k = 1 AS has_nc, c_custkey % 3 = 0 OR k = 2 AS has_png
          FROM {self.t('customer')} {self.each(3)} WHERE k < c_custkey % 4)"""

    # -- granules and requests ------------------------------------------------------------

    def granules(self) -> str:
        k = "o_orderkey"
        return f"""(SELECT 'G' || {k} AS granule_ur, 'C' || (o_custkey % 20) AS collection_id, {k} AS k,
            o_orderdate AS time_start, {self.plus_days('o_orderdate', '1')} AS time_end,
            CAST(-180 + {k} % 360 AS DOUBLE) AS w, CAST(-90 + o_custkey % 170 AS DOUBLE) AS s,
            CAST(CASE WHEN -180 + {k} % 360 + 10 > 180 THEN -180 + {k} % 360 - 350 ELSE -180 + {k} % 360 + 10 END AS DOUBLE) AS e,
            CAST(-80 + o_custkey % 170 AS DOUBLE) AS n,
            CAST(round(o_totalprice * 100) AS BIGINT) AS raw_size, {k} % 3 AS unit_kind,
            CAST({k} % 101 AS DOUBLE) AS cloud_cover,
            CASE {k} % 3 WHEN 0 THEN 'DAY' WHEN 1 THEN 'NIGHT' ELSE 'BOTH' END AS day_night_flag,
            CASE WHEN {k} % 3 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) / 1048576.0D
                 WHEN {k} % 3 = 1 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 1000 AS DOUBLE)
                 ELSE 0.0D END AS size_mb,
            CASE {k} % 4 WHEN 0 THEN 'https://opendap.example.org/c/' || {k} || '.html'
                 WHEN 1 THEN 'https://data.example.org/dap/' || {k} || '.nc4'
                 WHEN 2 THEN 'https://data.example.org/files/' || {k} || '.nc' END AS url,
            CASE WHEN {k} % 4 = 1 THEN 'Opendap Data' ELSE 'DIRECT DOWNLOAD' END AS subtype
          FROM {self.t('orders')})""".replace(".0D", ".0::DOUBLE" if self.duck else ".0D")

    def aois(self) -> str:
        k = "s_suppkey"
        start = "TIMESTAMP '1995-01-01'" if self.duck else "TIMESTAMP_NTZ '1995-01-01'"
        w = f"(-180 + ({k} * 37) % 360)"
        return f"""(SELECT {k} AS request_id, 'C' || ({k} % 20) AS collection_id, CAST({w} AS DOUBLE) AS w,
            CAST(-80 + ({k} * 13) % 120 AS DOUBLE) AS s,
            CAST(CASE WHEN {w} + 60 > 180 THEN {w} - 300 ELSE {w} + 60 END AS DOUBLE) AS e,
            CAST(-40 + ({k} * 13) % 120 AS DOUBLE) AS n,
            {self.plus_days(start, f'({k} * 29) % 2200')} AS t0,
            {self.plus_days(start, f'({k} * 29) % 2200 + CASE WHEN {k} % 10 = 0 THEN 900 WHEN {k} % 10 = 1 THEN 0 ELSE 400 END')} AS t1
          FROM {self.t('supplier')})"""

    def catalog_searches(self) -> str:
        """One search per part: by words, by a piece of a word, by names, by level, by time and place; many ask the same."""
        k = "p_partkey"
        none = lambda kind: f"CAST(NULL AS {kind})"
        start = "TIMESTAMP '1995-01-01'" if self.duck else "TIMESTAMP_NTZ '1995-01-01'"
        text = "VARCHAR" if self.duck else "STRING"
        stamp = "TIMESTAMP" if self.duck else "TIMESTAMP_NTZ"
        two = lambda a, b: f"['{a}', '{b}']" if self.duck else f"array('{a}', '{b}')"
        return f"""(SELECT {k} AS search_id,
            CASE {k} % 7 WHEN 0 THEN 'Daily ' || lower(substr(p_type, 1, 2)) WHEN 1 THEN '  fields  BUILDing Daily' WHEN 2 THEN '#0000' || ({k} % 300)
              WHEN 3 THEN 'daily' WHEN 4 THEN 'sn' || ({k} % 97) || ' household' END AS keyword,
            CASE WHEN {k} % 70 = 5 THEN 'C' || ({k} % 400) END AS concept_id,
            CASE WHEN {k} % 14 = 6 THEN 'SN' || ({k} % 97) END AS short_name,
            CASE WHEN {k} % 3 = 0 THEN 'PROV' || ({k} % 6) END AS provider,
            CASE WHEN {k} % 4 = 1 THEN {two('2', '4')} WHEN {k} % 4 = 2 THEN {two('1B', '1B')} END AS levels,
            CASE WHEN {k} % 5 = 1 THEN {k} % 2 = 0 END AS has_granules,
            CASE WHEN {k} % 6 = 2 THEN {self.plus_days(start, f'{k} % 900')} ELSE {none(stamp)} END AS t0,
            CASE WHEN {k} % 6 = 2 THEN {self.plus_days(start, f'{k} % 900 + 90')} WHEN {k} % 6 = 3 THEN {self.plus_days(start, f'{k} % 700')} ELSE {none(stamp)} END AS t1,
            CASE WHEN {k} % 8 = 5 THEN CAST(150 + {k} % 30 AS DOUBLE) WHEN {k} % 8 = 7 THEN CAST(-170 + {k} % 300 AS DOUBLE) END AS w,
            CASE WHEN {k} % 8 IN (5, 7) THEN CAST(-85 + {k} % 150 AS DOUBLE) END AS s,
            CASE WHEN {k} % 8 = 5 THEN CAST(-179 + {k} % 20 AS DOUBLE) WHEN {k} % 8 = 7 THEN CAST(-168 + {k} % 300 AS DOUBLE) END AS e,
            CASE WHEN {k} % 8 IN (5, 7) THEN CAST(-80 + {k} % 150 AS DOUBLE) END AS n,
            CASE WHEN {k} % 11 = 3 THEN 70 WHEN {k} % 11 = 4 THEN 3 END AS "limit", CAST(NULL AS {text}) AS colour
          FROM {self.t('part')})""".replace('"limit"', '"limit"' if self.duck else "`limit`")

    def granule_searches(self) -> str:
        """One granule search per supplier: the areas of interest, some open, with filters and an order of their own."""
        k = "request_id"
        return f"""(SELECT request_id, collection_id,
            CASE WHEN {k} % 4 <> 1 THEN t0 END AS t0, CASE WHEN {k} % 4 <> 1 THEN t1 END AS t1,
            CASE WHEN {k} % 6 <> 2 THEN w END AS w, CASE WHEN {k} % 6 <> 2 THEN s END AS s, CASE WHEN {k} % 6 <> 2 THEN e END AS e, CASE WHEN {k} % 6 <> 2 THEN n END AS n,
            CASE WHEN {k} % 5 = 0 THEN CAST(10 AS DOUBLE) END AS cloud_min, CASE WHEN {k} % 5 < 2 THEN CAST(80 AS DOUBLE) END AS cloud_max,
            CASE {k} % 7 WHEN 0 THEN 'Day' WHEN 1 THEN 'night' END AS day_night_flag,
            CASE {k} % 8 WHEN 0 THEN 'cloud_cover' WHEN 1 THEN '-cloud_cover' WHEN 2 THEN '-time_start' WHEN 3 THEN 'size_mb' WHEN 4 THEN '-size_mb'
              WHEN 5 THEN '-granule_ur' WHEN 6 THEN 'colour' END AS sort_key,
            CASE WHEN {k} % 9 = 0 THEN 60 WHEN {k} % 9 = 1 THEN 4 END AS "limit"
          FROM {self.aois()})""".replace('"limit"', '"limit"' if self.duck else "`limit`")

    def requests(self) -> str:
        k = "o_orderkey"
        needs = ", ".join(
            f"{self.bit(f'{k} % 64', i)} AS needs_{name}"
            for i, name in enumerate(("bbox", "variable", "temporal", "shape", "dimension", "reproject"))
        )
        return f"""(SELECT {k} AS request_id, 'C' || (o_custkey + CASE WHEN {k} % 50 = 0 THEN 1000000000 ELSE 0 END) AS collection_id,
            {needs}, {k} % 17 = 0 AS needs_point_sample,
            CASE {k} % 3 WHEN 0 THEN 'application/netcdf4' WHEN 1 THEN 'image/png' ELSE 'text/csv' END AS output_format,
            {k} % 5 <> 0 AS has_urls,
            CAST(-180 + {k} % 300 AS DOUBLE) AS w, CAST(-60 + o_custkey % 100 AS DOUBLE) AS s,
            CAST(CASE WHEN {k} % 9 = 0 THEN -181 + {k} % 300 ELSE -180 + {k} % 300 + 5 END AS DOUBLE) AS e,
            CAST(-55 + o_custkey % 100 AS DOUBLE) AS n
          FROM {self.t('orders')})"""

    # -- places ------------------------------------------------------------------------------

    def watersheds(self) -> str:
        k = "p_partkey"
        length = f"""CASE WHEN {k} % 6 = 0 AND {k} < 100 THEN 2 WHEN {k} % 6 = 1 AND {k} < 10000 THEN 4
            WHEN {k} % 6 = 2 AND {k} < 1000000 THEN 6 WHEN {k} % 6 = 3 THEN 8 WHEN {k} % 6 = 4 THEN 10 ELSE 12 END"""
        return f"""(SELECT lpad({self.text('k')}, len, '0') AS code, CAST({self.div('len', 2)} AS BIGINT) AS level, name,
            CAST(-120 + k % 60 AS DOUBLE) AS w, CAST(20 + k % 25 AS DOUBLE) AS s,
            CAST(-118 + k % 60 AS DOUBLE) AS e, CAST(22 + k % 25 AS DOUBLE) AS n
          FROM (SELECT {k} AS k, {length} AS len, p_name || ' Creek ' || {k} AS name FROM {self.t('part')}))"""

    def locations(self) -> str:
        k = "c_custkey"
        o, c = self.json_open, self.json_close
        polygon = (
            f"""'{o}"type":"Feature","properties":{o}"x":[1,2]{c},"bbox":[0,0,1,1],"geometry":{o}"type":"Polygon","coordinates":[[['"""
            f""" || (-100 + {k} % 50) || ',' || (10 + {k} % 40) || '.5,7],[' || (-90 + {k} % 50) || ',' || (15 + {k} % 40)"""
            f""" || '],[' || (-95 + {k} % 50) || '.25,' || (20 + {k} % 40) || ']]]{c}{c}'"""
        )
        half = self.div(k, 8)
        return f"""(SELECT {k} AS id, CASE {k} % 8
            WHEN 0 THEN (-170 + {k} % 340) || ', ' || (-80 + {k} % 90) || ',' || (-160 + {k} % 340) || ',' || (-70 + {k} % 90)
            WHEN 1 THEN CASE {half} % 4 WHEN 0 THEN '190,0,10,20' WHEN 1 THEN 'Colorado,37,-104,38'
                 WHEN 2 THEN '10,95,20,30' ELSE '10,40,20,30' END
            WHEN 2 THEN CASE WHEN {half} % 3 = 0 THEN 'Denver, CO' ELSE (-170 + {k} % 340) || '.5,' || ({k} % 90) END
            WHEN 3 THEN 'HUC-8 ' || lpad({self.text(half)}, 8, '0')
            WHEN 4 THEN lpad({self.text(half)}, CASE WHEN {half} % 2 = 0 THEN 4 ELSE 12 END, '0')
            WHEN 5 THEN CASE {half} % 4 WHEN 0 THEN ' Mena ' WHEN 1 THEN 'West Indies' WHEN 2 THEN 'africa' ELSE 'Far East' END
            WHEN 6 THEN CASE {half} % 5 WHEN 0 THEN 'creek ' || {half} WHEN 1 THEN {half} || ' river CREEK'
                 WHEN 2 THEN 'basin region' WHEN 3 THEN 'Nowhere ' || {half} ELSE 'ring watershed 1' || {half} END
            ELSE {polygon} END AS text FROM {self.t('customer')})"""

    def shapes(self) -> str:
        """GeoJSON of many kinds with the box each must give."""
        k = "c_custkey"
        o, c = self.json_open, self.json_close
        pair = lambda dx, dy, tail="": f"""'[' || ({k} % 100 + {dx}) || ',' || ({k} % 50 + {dy}) || '{tail}]'"""
        line = f"""'{o}"type":"LineString","coordinates":[' || {pair(0, 0)} || ',' || {pair(3, 9, ',100')} || ']{c}'"""
        point = f"""'{o}"type":"Point","coordinates":' || {pair(5, -7)} || '{c}'"""
        return f"""(SELECT {k} AS id, c_nationkey AS grp, CASE {k} % 4
            WHEN 0 THEN {line} WHEN 1 THEN {point}
            WHEN 2 THEN '{o}"type":"GeometryCollection","geometries":[' || {line} || ',' || {point} || ']{c}'
            ELSE '{o}"type":"FeatureCollection","bbox":[-1,-1,1,1],"features":[{o}"type":"Feature","properties":null,"geometry":'
              || {line} || '{c},{o}"type":"Feature","geometry":' || {point} || '{c}]{c}' END AS geojson,
            CAST({k} % 100 + CASE WHEN {k} % 4 = 1 THEN 5 ELSE 0 END AS DOUBLE) AS x_w,
            CAST({k} % 50 + CASE WHEN {k} % 4 = 0 THEN 0 ELSE -7 END AS DOUBLE) AS x_s,
            CAST({k} % 100 + CASE WHEN {k} % 4 = 0 THEN 3 ELSE 5 END AS DOUBLE) AS x_e,
            CAST({k} % 50 + CASE WHEN {k} % 4 = 1 THEN -7 ELSE 9 END AS DOUBLE) AS x_n
          FROM {self.t('customer')})"""

    def points(self) -> str:
        k = "s_suppkey"
        start = "TIMESTAMP '2024-01-01'" if self.duck else "TIMESTAMP_NTZ '2024-01-01'"
        return f"""(SELECT {k} AS point_id, CAST(-180 + ({k} * 53) % 360 AS DOUBLE) + 0.25 AS lon,
            CAST(-90 + ({k} * 31) % 180 AS DOUBLE) AS lat,
            {self.plus_days(start, f'{k} % 20')} AS t0, {self.plus_days(start, f'{k} % 20 + 5')} AS t1
          FROM {self.t('supplier')})"""

    # -- lineage --------------------------------------------------------------------------------

    def edges(self) -> str:
        """Workspace a: orders to regions with a diamond, part chains up to 149 long, a cycle
        of regions. Workspace b: conversation turns, and nations again."""
        def nation(ws: str) -> str:
            return f"""
          SELECT '{ws}' AS ws, 'n' || n_nationkey AS target, 'n' || (n_nationkey - 1) AS source, n_nationkey + 0 AS id
            FROM {self.t('nation')} WHERE n_nationkey % 5 > 0
          UNION ALL SELECT '{ws}', 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey + 100 FROM {self.t('nation')}"""

        return f"""({nation('a')}
          UNION ALL {nation('b')}
          UNION ALL SELECT 'a', 'o' || o_orderkey, 'c' || o_custkey, o_orderkey FROM {self.t('orders')}
          UNION ALL SELECT 'a', 'o' || o_orderkey, 's' || (o_orderkey % 10), o_orderkey FROM {self.t('orders')}
          UNION ALL SELECT 'a', 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM {self.t('customer')}
          UNION ALL SELECT 'a', 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM {self.t('supplier')}
          UNION ALL SELECT 'a', 'p' || p_partkey, 'p' || (p_partkey - 1), p_partkey FROM {self.t('part')} WHERE p_partkey % 150 > 0
          UNION ALL SELECT 'a', 'r' || r_regionkey, 'r' || ((r_regionkey + 1) % 5), r_regionkey + 0 FROM {self.t('region')}
          UNION ALL SELECT 'b', 't' || conv_id || '_' || turn, 't' || conv_id || '_' || (turn - 1), conv_id
            FROM {self.t('conversations')} WHERE turn > 0)"""

    def spec_edges(self) -> str:
        """Edges with specs: plain, none, a URL as value, in a list, under an exempt key, nested."""
        k = "o_orderkey"
        o, c = self.json_open, self.json_close
        return f"""(SELECT CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS ws, 'obs_' || (o_custkey % 500) AS target,
            'dataset_' || (o_custkey % 97) AS source, {k} AS id, o_orderdate AS created_at, {k} % 7 AS spec_kind,
            CASE {k} % 7 WHEN 0 THEN NULL
              WHEN 1 THEN '{o}"url":"HTTPS://x.example/' || {k} || '"{c}'
              WHEN 2 THEN '{o}"files":["a","s3://b/' || {k} || '"]{c}'
              WHEN 3 THEN '{o}"opendap_urls":["https://x.example/' || {k} || '"]{c}'
              WHEN 4 THEN '{o}"nested":{o}"u":"gs://x"{c},"n":' || {k} || '{c}'
              WHEN 5 THEN '{o}"text":"[\\\\"http://x\\\\"]","n":' || {k} || '{c}'
              ELSE '{o}"op":"subset","n":' || {k} || '{c}' END AS spec
          FROM {self.t('orders')})""".replace("\\\\", "\\" if self.duck else "\\\\")

    def events_log(self) -> str:
        kinds = ("created", "routed", "submitted", "provider-fallback", "opendap-not-applicable",
                 "job-failed", "materialized", "expired", "re-materialized")
        whens = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
        return f"""(SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS ws, 'obs_' || (user_id % 40) AS handle,
            event_id AS id, CASE event_id % 10 {whens} ELSE 'deleted' END AS event_type, ts AS created_at,
            CASE WHEN event_id % 3 = 0 THEN props END AS detail FROM {self.t('events')})"""

    def handles(self) -> str:
        k = "c_custkey"
        o, c = self.json_open, self.json_close
        return f"""(SELECT CASE {k} % 4 WHEN 0 THEN 'obs_' WHEN 1 THEN 'cube_' WHEN 2 THEN 'dataset_' ELSE 'aoi_' END || {k} AS handle,
            CASE WHEN {k} % 3 = 0 THEN 'a' ELSE 'b' END AS owner, {k} AS k,
            '{o}"status":"' || CASE WHEN {k} % 5 = 0 THEN 'pending' ELSE 'ready' END || '"'
              || CASE WHEN {k} % 7 = 0 THEN '' ELSE ',"storage_key":"k/' || {k} || '"' END || ',"media_type":"text/csv"{c}' AS payload,
            {self.plus_days("TIMESTAMP '2024-01-01'" if self.duck else "TIMESTAMP_NTZ '2024-01-01'", f'{k} % 30')} AS created_at
          FROM {self.t('customer')})"""

    def job_log(self) -> str:
        states = ("pending", "submitted", "running", "materializing", "ready", "expired", "failed", "cancelled")
        whens = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(states))
        return f"""(SELECT user_id AS job_id, event_id AS seq,
            CASE ({self.div('event_id', 37)} + event_id) % 8 {whens} END AS state,
            event_id % 101 AS progress, CASE WHEN event_id % 8 = 6 THEN 'boom ' || event_id END AS error,
            ts AS created_at FROM {self.t('events')})"""


SPARK, DUCK = Views(False), Views(True)


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a view's SQL text over the driver tables."""
    used = {n for n in TABLES if re.search(r"\{" + n + r"\}", text)}
    return spark.sql(f"SELECT * FROM {text}", **{n: table(spark, sf_dir, n) for n in used})


# -- JSON records built from the views ----------------------------------------------------


def granule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, SPARK.granules())
    entry = F.when(
        F.col("unit_kind") == 0, F.struct(F.col("raw_size").alias("SizeInBytes"),
                                          F.lit(None).cast("string").alias("Size"), F.lit("B").alias("SizeUnit"))
    ).otherwise(
        F.struct(F.lit(None).cast("long").alias("SizeInBytes"),
                 F.when(F.col("unit_kind") == 1, F.col("raw_size") % 1000).otherwise(F.col("raw_size")).cast("string").alias("Size"),
                 F.when(F.col("unit_kind") == 1, "MB").otherwise("KB").alias("SizeUnit"))
    )
    page = F.struct(F.lit("https://example.org/page").alias("URL"), F.lit("VIEW").alias("Type"), F.lit(None).cast("string").alias("Subtype"))
    urls = F.when(F.col("url").isNull(), F.array(page)).otherwise(
        F.array(page, F.struct(F.col("url").alias("URL"), F.lit("GET DATA").alias("Type"), F.col("subtype").alias("Subtype")))
    )
    return g.select(
        "granule_ur", "collection_id", "time_start", "time_end", "w", "s", "e", "n",
        F.to_json(F.struct(
            F.struct(F.col("granule_ur").alias("concept-id")).alias("meta"),
            F.struct(
                F.col("granule_ur").alias("GranuleUR"), urls.alias("RelatedUrls"), F.col("cloud_cover").alias("CloudCover"),
                F.struct(F.col("day_night_flag").alias("DayNightFlag"),
                         F.array(entry).alias("ArchiveAndDistributionInformation")).alias("DataGranule"),
            ).alias("umm"),
        )).alias("raw"),
    )


def collection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, SPARK.collections())
    k = F.col("k")
    rect = F.when(F.col("extent_kind") == 0, F.array(F.struct(
        F.col("w").alias("WestBoundingCoordinate"), F.col("s").alias("SouthBoundingCoordinate"),
        F.col("e").alias("EastBoundingCoordinate"), F.col("n").alias("NorthBoundingCoordinate"))))
    at = lambda x, y: F.struct(F.col(x).alias("Longitude"), F.col(y).alias("Latitude"))
    poly = F.when(F.col("extent_kind") == 1, F.array(F.struct(F.struct(
        F.array(at("w", "n"), at("e", "n"), at("e", "s"), at("w", "s"), at("w", "n")).alias("Points")).alias("Boundary"))))
    fmt = lambda x: F.struct(F.col(x).alias("Format"), F.lit("Online").alias("Media"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("V"), k.cast("string"), F.lit("_"), i.cast("string")))
    return c.select("concept_id", F.to_json(F.struct(
        F.struct(
            F.col("concept_id").alias("concept-id"), F.col("provider_id").alias("provider-id"),
            F.col("revision_id").alias("revision-id"),
            F.struct(
                F.when(k % 4 != 3, ids).alias("variables"),
                F.array(F.concat(F.lit("S"), (k % 120).cast("string"))).alias("services"),
                F.when(F.col("n_citing") > 0, F.transform(
                    F.sequence(F.lit(1).cast("long"), F.col("n_citing").cast("long")),
                    lambda i: F.concat(F.lit("CIT"), i.cast("string")))).alias("citations"),
            ).alias("associations"),
        ).alias("meta"),
        F.struct(
            F.col("short_name").alias("ShortName"), F.col("version").alias("Version"),
            F.col("entry_title").alias("EntryTitle"), F.col("abstract").alias("Abstract"),
            F.when(F.col("processing_level").isNotNull(), F.struct(F.col("processing_level").alias("Id"))).alias("ProcessingLevel"),
            F.when(F.col("doi").isNotNull(), F.struct(F.col("doi").alias("DOI"), F.lit("https://doi.org").alias("Authority"))).alias("DOI"),
            F.struct(F.array(fmt("fmt1"), fmt("fmt2")).alias("FileDistributionInformation")).alias("ArchiveAndDistributionInformation"),
            F.when(F.col("direct_region").isNotNull(), F.struct(F.col("direct_region").alias("Region"))).alias("DirectDistributionInformation"),
            F.col("standard_product").alias("StandardProduct"), F.col("purpose").alias("Purpose"),
            F.col("collection_progress").alias("CollectionProgress"),
            F.struct(F.struct(F.struct(rect.alias("BoundingRectangles"), poly.alias("GPolygons")).alias("Geometry")).alias("HorizontalSpatialDomain")).alias("SpatialExtent"),
        ).alias("umm"),
    )).alias("raw"))


def _dimensions() -> F.Column:
    dim = lambda i: F.when(F.col(f"d{i}").isNotNull(), F.struct(F.col(f"d{i}").alias("Name"), F.col(f"n{i}").alias("Size")))
    return F.array_compact(F.array(dim(1), dim(2), dim(3)))


def variable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, SPARK.variables())
    return v.select("collection_id", "pos", F.to_json(F.struct(
        F.struct(F.col("concept_id").alias("concept-id")).alias("meta"),
        F.struct(
            F.col("name").alias("Name"), F.col("standard_name").alias("StandardName"), F.col("units").alias("Units"),
            F.col("scale").alias("Scale"),
            F.when(F.col("fill").isNotNull(), F.array(F.struct(F.col("fill").alias("Value")))).alias("FillValues"),
            F.when(F.col("pos") == 3, F.array(F.struct(F.lit(0.0).alias("Min"), F.lit(100.0).alias("Max")))).alias("ValidRanges"),
            _dimensions().alias("Dimensions"),
        ).alias("umm"),
    )).alias("raw"))


def variable_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``collection_id, pos, name, standard_name, dimensions`` without the JSON detour."""
    v = view(spark, sf_dir, SPARK.variables())
    dims = F.transform(_dimensions(), lambda d: F.struct(d["Name"].alias("name"), d["Size"].alias("size")))
    return v.select("collection_id", "pos", "name", "standard_name", dims.alias("dimensions"))


def capability_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per collection, built from the flat service view. The rolled-up flags at
    the top are all true, to show that nothing reads them."""
    s = view(spark, sf_dir, SPARK.services())
    formats = F.array_compact(F.array(
        F.when(F.col("has_nc"), "application/netcdf4"), F.when(F.col("has_png"), "image/png")))
    one = F.struct(
        F.col("pos"), F.col("service_name").alias("name"),
        F.concat(F.lit("https://catalog.example.org/concepts/"), F.col("service_id")).alias("href"),
        F.struct(
            F.struct(*[F.when(F.col(x), F.lit(True)).alias(x) for x in ("bbox", "variable", "temporal", "shape", "dimension")]).alias("subsetting"),
            F.col("concatenate").alias("concatenation"), F.col("reproject").alias("reprojection"),
            formats.alias("output_formats"),
        ).alias("capabilities"),
    )
    docs = s.groupBy("collection_id").agg(F.array_sort(F.collect_list(one)).alias("services"))
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("collection_id"), "c_custkey")
    return known.join(docs, "collection_id", "left").select(
        F.col("collection_id").alias("concept_id"),
        F.to_json(F.struct(
            F.col("collection_id").alias("conceptId"),
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("HSN"), (F.col("c_custkey") % 10).cast("string"))).otherwise("").alias("shortName"),
            F.lit(True).alias("bboxSubset"), F.lit(True).alias("variableSubset"), F.lit("2").alias("capabilitiesVersion"),
            F.coalesce("services", F.array()).alias("services"),
        )).alias("raw"),
    )
