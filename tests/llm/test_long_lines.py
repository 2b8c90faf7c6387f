"""Lines of any length count as a host's furniture."""

from weftlink.llm.quality import quality_rules, without_boilerplate

from . import brute as B


def test_long_notice_is_counted(spark):
    notice = " ".join(f"notice{k}" for k in range(40))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(30))
    docs = [(i, f"{notice}\n{own(i)}", "h") for i in range(12)]
    docs += [(20, f"{notice}\n{own(20)}", "other"), (21, f"{notice}\none two three", "h")]
    df = B.frame(spark, docs)
    found = quality_rules(df)
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(got[i]["n_line_words"] == 40 and got[i]["kept"] for i in range(12))
    assert got[20]["n_line_words"] == 0 and got[20]["kept"]
    assert got[21]["n_line_words"] == 40 and got[21]["depleted"] and not got[21]["kept"]
    left = df.join(found.select("doc_id", "boilerplate"), "doc_id").select("doc_id", without_boilerplate(df["text"], found["boilerplate"]).alias("t"))
    assert {r["doc_id"]: r["t"] for r in left.collect()}[3] == own(3)
