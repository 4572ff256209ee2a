"""Framework files: what ships can be written out and read back, and broken files are refused."""

import pytest

from tallyframe.sources import specdata, specs

yaml = pytest.importorskip("yaml")


def write(folder, raws):
    for raw in raws:
        (folder / f"{raw['name']}.yaml").write_text(yaml.safe_dump(raw, allow_unicode=True, sort_keys=False), encoding="utf-8")


def test_files_give_what_ships(tmp_path):
    write(tmp_path, specdata.SHIPPED)
    assert specs.load(tmp_path) == specs.shipped()


def test_broken_files_are_refused(tmp_path):
    with pytest.raises(specs.SpecError, match="no framework files"):
        specs.load(tmp_path)
    own = {"name": "own", "display_name": "Own", "extends": "generic", "remove_metrics": ["not_there"]}
    write(tmp_path, [specdata.GENERIC, own])
    with pytest.raises(specs.SpecError, match="not_there"):
        specs.load(tmp_path)
    (tmp_path / "own.yaml").write_text("name: other\n")
    with pytest.raises(specs.SpecError, match="file name"):
        specs.load(tmp_path)
    write(tmp_path, [own | {"remove_metrics": [], "metrics": [specdata.GENERIC["metrics"][0]] * 2}])
    with pytest.raises(specs.SpecError, match="duplicate"):
        specs.load(tmp_path)


def test_a_file_extends_and_overrides(tmp_path):
    revenue = specdata.GENERIC["metrics"][0] | {"name": "Turnover"}
    write(tmp_path, [specdata.GENERIC, {"name": "own", "display_name": "Own", "extends": "generic", "metrics": [revenue], "remove_charts": ["margins"]}])
    own = specs.load(tmp_path)["own"]
    assert own.metrics["revenue"].name == "Turnover" and "margins" not in own.charts and own.drivers.keys() == specs.shipped()["generic"].drivers.keys()
