import corpus_pipeline as C
from basketlab.llm.decontaminate import contaminated_pairs
from basketlab.llm.neardup import near_duplicate_classes
from basketlab.llm.secrets import BASE, RULES, find_secrets
from basketlab.session import materialize


def test_stages_and_their_decisions(spark, sf_small):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    planted = spark.createDataFrame(
        [(10 ** 6 + k, t, "en", "src0", len(t)) for k, t in enumerate(
            [docs.where("doc_id = 1").first().text] * 3
            + [spark.read.parquet(f"{sf_small}/benchmark.parquet").first().text + " and more."]
            + ["plain words then password = abcdefghijklmnop here"])], docs.schema)
    cur, seen = docs.unionByName(planted), {}
    for name, stage in C.STAGES:
        cur = materialize(stage(spark, cur, sf_small), name)
        assert cur.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in cur.collect()}
    copies = {1, 10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2}
    assert copies <= set(seen["toxicity"]) and copies & set(seen["near_duplicates"]) == {1}
    assert 10 ** 6 + 3 in seen["near_duplicates"] and 10 ** 6 + 3 not in seen["decontamination"]
    assert seen["secrets"][10 ** 6 + 4] == "plain words then [assign] here"
    assert set(seen["secrets"]) == set(seen["decontamination"]) and set(seen["mixing"]) <= set(seen["secrets"])


def test_run_on_the_table(spark, sf_small):
    out = materialize(C.run(spark, sf_small), "run")
    assert out.count() > 0
    assert near_duplicate_classes(out.dropDuplicates(["doc_id"])).where("id <> class_id").count() == 0
    assert contaminated_pairs(out, spark.read.parquet(f"{sf_small}/benchmark.parquet")).count() == 0
    assert find_secrets(out, RULES[:len(BASE)]).where("size(spans) > 0").count() == 0


def test_awkward_rows_go_through_all_stages(spark, sf_small, docs, rows):
    """Nulls in any column, empty and long texts, repeated rows and columns
    with clashing names."""
    cur, seen = docs, {}
    for name, stage in C.STAGES:
        cur = materialize(stage(spark, cur, sf_small), name)
        assert cur.schema.names == docs.schema.names
        seen[name] = [(r.doc_id, r.text, r.source, r.size, r.row) for r in cur.collect()]
    given = {(r[0], r[1], r[3], r[6], r[7]) for r in rows}
    assert all(set(seen[n]) <= given for n in ("toxicity", "near_duplicates", "decontamination"))
    changed = {t for _, t, *_ in seen["secrets"]} - {t for _, t, *_ in given}
    assert changed == {"[hex]"}                                 # the texts of one repeated letter or two
    assert {x[0] for x in seen["mixing"]} <= {x[0] for x in seen["secrets"]}
    assert None in [t for _, t, *_ in seen["secrets"]] and "" in [t for _, t, *_ in seen["secrets"]]
    assert any(i is None for i, *_ in seen["secrets"])
    ids = [i for i, *_ in seen["near_duplicates"] if i is not None]
    assert len(ids) == len(set(ids))


def test_an_empty_table_stays_empty(spark, sf_small, nothing):
    cur = nothing
    for name, stage in C.STAGES:
        cur = materialize(stage(spark, cur, sf_small), name)
        assert cur.schema.names == nothing.schema.names and cur.count() == 0
