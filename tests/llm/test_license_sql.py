import os

import duckdb
from check_oracles import compare

from caselight.llm import licenses, oracles, queries


def test_the_sql_finds_every_known_sentence(spark, tmp_path):
    known = list(licenses.SENTENCES.values())
    texts = ["intro. " + " ".join(known[i : i + 4]) + " tail" for i in range(len(known))]
    texts += ["\n".join(known[i : i + 3]) for i in range(len(known))] + ["\n\n".join(known[::-1]), None, "", "nothing of this kind. here"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    (name,) = [x for x in os.listdir(path) if x.endswith(".parquet")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/{name}')")
    out = queries.op5_license_scan(spark, str(tmp_path))
    assert compare(out, con, oracles.ORACLES["op5_license_scan"]) == ""
    assert {x for r in out.collect() for x in r["sentence_ids"].split(",") if x} == set(licenses.SENTENCES)
