from chronoscape.functions import settings
from chronoscape.operators.detect import PRESETS


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    assert settings.load(path) == {}
    assert settings.save(path, a=1, b=2) and settings.save(path, b=3)
    assert settings.load(path) == {"a": 1, "b": 3}
    path.write_text("not json")
    assert settings.load(path) == {}
    assert not settings.save(tmp_path / "missing" / "s.json", a=1)


def test_description():
    assert "3 dB" in settings.describe(PRESETS["Balanced"]) and "1 in 100,000" in settings.describe(PRESETS["Balanced"])
