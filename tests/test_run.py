import numpy as np
import pytest

from tessella.plans import run as runs
from tessella.sources.tables import RunConfig, read_status


@pytest.mark.parametrize("known_types", [True, False])
def test_a_run_from_its_configuration(spark, tmp_path, known_types):
    """Samples go from one kind of cells to the other; the run finds that order, and does nothing twice."""
    rng = np.random.default_rng(11)
    kinds = rng.gamma(0.4, 3, (2, 60)) + 0.05
    counts, cells = [], []
    for s in range(12):
        for _ in range(30):
            cell, kind = len(cells), int(rng.random() < 0.1 + 0.07 * s)
            cells.append((cell, f"s{s:02d}", f"t{kind}", "xy"[s % 2], float(s)))
            counts += [(cell, f"g{g}", float(v)) for g, v in enumerate(rng.poisson(kinds[kind])) if v]
            if cell % 40 == 0:
                counts.append((cell, "MT-1", 900.0))
    spark.createDataFrame(counts, "cell_id long, feature_id string, value double").write.parquet(str(tmp_path / "in/counts.parquet"))
    spark.createDataFrame(cells, "cell_id long, sample string, celltype string, batch string, age double").write.parquet(str(tmp_path / "in/cells.parquet"))
    spark.createDataFrame([(f"g{g}",) for g in range(60)], "feature_id string").write.parquet(str(tmp_path / "in/features.parquet"))
    config = RunConfig(input=str(tmp_path / "in"), output=str(tmp_path / "out"), celltype_column="celltype" if known_types else "", batch_column="", target_column="age" if known_types else "", min_cells=10, min_features=5, variable_features=40, components=5, k_medium=4, k_fine=6, cell_types=2)
    assert list(runs.run(spark, config)) == list(runs.STAGES)
    table = lambda t: spark.read.parquet(str(tmp_path / f"out/{t}.parquet"))
    kept = {r["cell_id"] for r in table("quality_cells").collect()}
    assert kept == {c[0] for c in cells if c[0] % 40} and not table("quality_counts").where("feature_id = 'MT-1'").count()
    time = {r["unit"]: r["pseudotime"] for r in table("pseudotime").collect()}
    if known_types:
        assert len(time) == 12 and np.corrcoef([time[f"s{s:02d}"] for s in range(12)], range(12))[0, 1] > 0.8
    else:
        true = {c[0]: c[2] for c in cells}
        found = {(true[r["cell_id"]], r["celltype"]): 0 for r in table("cell_types").collect()}
        assert len(found) >= 2 and len(time) > 0
    assert {r["metric"] for r in table("distances").collect()} == set(runs.METRICS) and table("distances").where("metric = 'cosine'").count() == 66
    assert runs.run(spark, config) == {} and all(read_status(spark, f"{config.output}/status").values())
