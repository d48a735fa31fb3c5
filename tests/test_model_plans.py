import pytest

from shelfline.fixed import FOREST_TREES, PRIMARY_MODELS, PRODUCERS
from shelfline.operators import forecast as fc
from shelfline.operators import models as mo
from shelfline.plans import catalog_models as cm


class Planned(Exception):
    """Stops a query where its fits would begin."""


@pytest.mark.parametrize("name, models, fits", [("random_forest", ["random_forest"], 16), ("boosted_trees", PRIMARY_MODELS, 1152)])
def test_registered_queries_fit_the_whole_plan(spark, sf_dir, monkeypatch, name, models, fits):
    def stop(training, origins, candidates, forest_trees=FOREST_TREES):
        raise Planned(sorted(candidates), forest_trees)

    monkeypatch.setattr(mo, "fit_candidates", stop)
    with pytest.raises(Planned) as planned:
        getattr(cm, name)(spark, sf_dir)
    found, trees = planned.value.args
    assert found == sorted(c[1:] for c in fc.candidate_plan(models)) and len(found) == fits and trees == 300


def test_final_refit_has_the_designated_producers(spark, sf_dir, monkeypatch):
    def stop(training, origins, candidates):
        raise Planned(candidates)

    monkeypatch.setattr(mo, "fit_candidates", stop)
    with pytest.raises(Planned) as planned:
        cm.final_refit(spark, sf_dir)
    assert {(m, h, c, 5) for h, m, c in PRODUCERS} <= set(planned.value.args[0])
