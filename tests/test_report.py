from paronym.operators.report import evaluation_report, export_importances, write_report


def test_report_and_exports(spark, tmp_path):
    rows = [(i, int(i % 4 == 0), 0.9 - i / 200 if i % 4 == 0 else 0.4 - i / 200) for i in range(60)]
    scored = spark.createDataFrame(rows, "pair_id int, y int, score double")
    lines = evaluation_report(scored)
    assert lines[0] == "# Avaliação" and "Pares: 60; positivos: 15." in lines and "| roc_auc | 1.0000 | verde |" in lines and sum(line.startswith("| ") for line in lines) > 12
    write_report(scored, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).first().value.rstrip("\n") == "\n".join(lines)
    assert evaluation_report(scored.where("false"))[-1] == "Sem pares, sem medidas."
    export_importances(spark.createDataFrame([("graf_jaro", 0.3), ("cls_same", 0.1), ("x", -1.0)], "feature string, importance double"), str(tmp_path / "i"))
    out = spark.read.option("header", True).csv(str(tmp_path / "i")).collect()
    assert [(r.feature, r.block, r.position) for r in out] == [("graf_jaro", "grafia", "1"), ("cls_same", "classe", "2"), ("x", "outros", "3")] and round(float(out[0].share), 9) == 0.75
