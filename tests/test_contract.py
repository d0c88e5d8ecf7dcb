import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from inkstream.plans.bridge import _BASES

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "jn9_match_any_all jn8_plan_deliveries flt4_due_deliveries agg2_attachment_bytes jn15_agg4_agg5_site_health jn4_agg3_tags_per_group "
    "url1_canonical_url str2_simhash_md5 dt4_dt5_quiet_hours top7_ordered_tags jsn1_jsn2_agg11_top4_tag_responses"
).split()


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for base in _BASES:
        con.execute(f"CREATE VIEW {base} AS SELECT * FROM '{SMALL}/{base}.parquet'")
    frame = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(result.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
