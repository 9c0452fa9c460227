"""Settings."""

from marginalia.config import Settings


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("MARGINALIA_TOP_K", "5")
    monkeypatch.setenv("MARGINALIA_MIN_SIMILARITY", "0.5")
    monkeypatch.setenv("MARGINALIA_SUMMARIZE_WITH_MODEL", "false")
    found = Settings.from_env()
    assert (found.top_k, found.min_similarity, found.summarize_with_model) == (5, 0.5, False)
