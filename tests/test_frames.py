"""Places that a turn over a pole or around it leaves."""

import duckdb
from compare import rows, sql_rows

from starloom.operators import geometry
from starloom.plans.queries import ORACLES, QUERIES


def test_round_trip_of_declinations_over_a_pole(spark, tmp_path):
    """Users so many that their declinations pass both poles several times: the way back is the SQL's."""
    duckdb.execute(
        f"""copy (select i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 1 second AS ts, (i * 7 - 40000)::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{"k": 1}}' AS props
        from range(12000) t(i) union all select 20000 + i, TIMESTAMP '2024-01-01' + i * INTERVAL 1 second, 3500, 'view', 1.0, '{{"k": 1}}' from range(97 * 13) t(i)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        duckdb.execute(f"copy (select 1 as a) to '{tmp_path}/{t}.parquet' (format parquet)")
    assert rows(QUERIES["frame_round_trip"](spark, str(tmp_path))) == sql_rows(ORACLES["frame_round_trip"], str(tmp_path))


def test_round_trip_keeps_turns_and_poles(spark):
    places = [(0.0, 0.0), (359.9999999999999, 10.0), (-0.5, 90.0), (725.0, 89.99), (10.0, 270.0), (-370.0, -200.0), (192.8595, 27.1284), (12.0, 179.9999999), (None, 3.0)]
    sky = spark.createDataFrame(places, "ra double, dec double")
    found = geometry.to_equatorial(geometry.to_galactic(sky, branch="b"), branch="b").collect()
    for (ra, dec), r in zip(places, found):
        assert r.ra is None if ra is None else abs(r.ra - ra) < 2e-6 and abs(r.dec - dec) < 2e-6
    plain = geometry.to_equatorial(geometry.to_galactic(sky)).collect()
    assert plain[4].dec < -89.999 and plain[5].dec - 20 < 1e-9 and all(0 <= r.ra < 360 for r in plain[:-1])
