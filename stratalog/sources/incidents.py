"""The catalog of incidents: what templates stand for each, and how far back its windows look."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from stratalog.sources.discovery import load_json, save_json


@dataclass
class Incident:
    """name; the templates that show it, the first of them the anchor; minutes of look-back at first and at most; bucket filters."""

    name: str
    templates: list[str]
    lookback_minutes: int = 15
    most_minutes: int = 60
    filters: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.templates:
            raise ValueError(f"incident {self.name} has no template")
        if not 0 < self.lookback_minutes <= self.most_minutes:
            raise ValueError(f"incident {self.name} looks back {self.lookback_minutes} of at most {self.most_minutes} minutes")
        self.templates = [str(t) for t in self.templates]

    @property
    def anchor(self) -> str:
        return self.templates[0]


class Catalog:
    """Incidents by name, kept as one JSON text in the store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.incidents = spark, path, {}
        try:
            found = load_json(spark, path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        else:
            self.incidents = {i["name"]: Incident(**i) for i in found["incidents"]}

    def names(self) -> list[str]:
        return sorted(self.incidents)

    def get(self, name: str) -> Incident:
        if name not in self.incidents:
            raise KeyError(f"no incident {name}; there are {', '.join(self.names()) or 'none'}")
        return self.incidents[name]

    def put(self, incident: Incident) -> None:
        """Add an incident, or take the place of one of its name."""
        self.incidents[incident.name] = incident
        self._save()

    def remove(self, name: str) -> None:
        self.get(name)
        del self.incidents[name]
        self._save()

    def _save(self) -> None:
        save_json(self.spark, self.path, {"incidents": [asdict(self.incidents[n]) for n in self.names()]})
