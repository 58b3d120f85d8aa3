"""The registered model queries fit the models of the description, none smaller."""

import pytest

from tendermill.catalog import load
from tendermill.plans import regression


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["model_comparison", "next_week_prediction"])
def test_models_are_fitted_in_full(spark, tiny, monkeypatch, name):
    whole = regression.models()

    def models(*how, **named):
        made = regression_models(*how, **named)
        raise Asked(made["Random Forest"].getNumTrees(), made["Gradient Boosting"].getMaxIter())

    regression_models = regression.models
    monkeypatch.setattr(regression, "models", models)
    with pytest.raises(Asked) as asked:
        load()[name].run(spark, tiny)
    assert asked.value.args == (200, 200) == (whole["Random Forest"].getNumTrees(), whole["Gradient Boosting"].getMaxIter())
