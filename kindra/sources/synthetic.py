"""Generated linkage data: businesses of several markets, their noisy records in two more sources, and distractors.

Every draw comes from one seeded generator per split, so a seed gives the same files everywhere.
"""

from __future__ import annotations

import os
import random
from dataclasses import dataclass, replace

from kindra.sources.tables import RECORD_COLUMNS, TRUTH_COLUMNS


@dataclass(frozen=True)
class Market:
    """Words that names and addresses of a country are made of."""

    label: str
    aliases: tuple[str, ...]
    first: tuple[str, ...]
    second: tuple[str, ...]
    legal: tuple[str, ...]
    streets: tuple[str, ...]
    kinds: tuple[tuple[str, str], ...]
    cities: tuple[tuple[str, str, str], ...]
    chains: tuple[str, ...]
    number_first: bool = True


MARKETS = {
    "us": Market(
        "US", ("USA", "United States", "U.S."), ("Harbor", "Cedar", "Summit", "Golden", "Prairie", "Whitfield", "Okafor", "Lindqvist", "Saint Anne's", "Northgate", "Bluebird", "Delgado"),
        ("Dental Center", "Hardware", "Roofing Services", "Pharmacy", "Bakery", "Auto Repair", "Consulting Group", "Coffee House", "Insurance Agency", "Medical Laboratory", "Florist", "Legal Associates"),
        ("LLC", "Inc.", "Corporation", "", ""), ("Maple", "Lincoln", "Juniper", "Harrison", "Riverside", "Walnut", "Franklin", "Sycamore", "Oakdale", "Prospect"), (("Street", "St"), ("Avenue", "Ave"), ("Road", "Rd"), ("Boulevard", "Blvd"), ("Drive", "Dr")),
        (("Columbus", "OH", "432"), ("Tucson", "AZ", "857"), ("Austin", "TX", "787"), ("Portland", "OR", "972"), ("Madison", "WI", "537"), ("Raleigh", "NC", "276")), ("Quick Lube", "Corner Bagel", "Sunny Mart", "Fit Factory"),
    ),
    "in": Market(
        "India", ("IN", "IND", "Bharat"), ("Shree Ganesh", "Sri Lakshmi", "Annapurna", "Mohammed Iqbal", "Royal", "Bharat", "Om Sai", "Patel", "Krishna", "New Bombay", "Sharma", "Jaya"),
        ("Traders", "Medical Stores", "Enterprises", "Electricals", "Sweets", "Textiles", "Hospital", "Engineering Works", "Travels", "Jewellers", "Hardware", "Industries"),
        ("Private Limited", "Pvt. Ltd.", "LLP", "", ""), ("Gandhi", "Nehru", "Station", "Temple", "Market", "Lake", "Fort", "College", "Tank", "Mission"), (("Road", "Rd"), ("Nagar", "Ngr"), ("Marg", "Mrg"), ("Colony", "Clny"), ("Layout", "Lyt")),
        (("Mumbai", "Maharashtra", "400"), ("Bengaluru", "Karnataka", "560"), ("Chennai", "Tamil Nadu", "600"), ("Kolkata", "West Bengal", "700"), ("Pune", "Maharashtra", "411"), ("Kochi", "Kerala", "682")), ("Apna Bazaar", "Chai Corner", "City Diagnostics"),
    ),
    "fr": Market(
        "France", ("FR", "FRA"), ("Boulangerie", "Pharmacie", "Garage", "Librairie", "Maison", "Atelier", "Clinique", "Hôtel", "Épicerie", "Fleuriste"), ("Dupré", "du Marché", "Saint-Rémy", "de l'Étoile", "Lefèvre", "des Halles", "Garnier", "du Château", "Bérenger", "Noël"),
        ("SARL", "SAS", "EURL", "", ""), ("Victor Hugo", "de la République", "des Lilas", "Pasteur", "du Moulin", "Voltaire", "de la Gare", "Molière"), (("rue", "r"), ("avenue", "av"), ("boulevard", "bd"), ("place", "pl")),
        (("Lyon", "", "690"), ("Nantes", "", "440"), ("Lille", "", "590"), ("Dijon", "", "210"), ("Rennes", "", "350")), ("Presse Express", "Café Central"),
    ),
}
TWO_FORMS = (("Center", "Ctr"), ("Services", "Svcs"), ("Private Limited", "Pvt Ltd"), ("Corporation", "Corp"), ("Hospital", "Hosp"), ("Associates", "Assoc"), ("Shree", "Sri"), ("Mohammed", "Mohd"), ("Saint", "St"), ("Laboratory", "Lab"), ("Group", "Grp"), ("Insurance", "Ins"))


@dataclass(frozen=True)
class Business:
    country: str
    name: str
    number: str
    street: str
    kind: int
    city: int
    postal: str


@dataclass(frozen=True)
class Settings:
    n: int = 3000
    countries: tuple[tuple[str, float], ...] = (("us", 0.5), ("in", 0.5))
    matches: tuple[float, ...] = (0.30, 0.36, 0.20, 0.10, 0.04)
    chain_share: float = 0.12
    distractors: tuple[tuple[str, float], ...] = (("fresh", 0.20), ("sibling", 0.30), ("neighbour", 0.25), ("near_name", 0.25))
    noise: tuple[float, float] = (1.5, 2.2)
    partial_address: float = 0.06
    country_alias: float = 0.05
    country_missing: float = 0.01
    seed: int = 7


class Generator:
    def __init__(self, settings: Settings) -> None:
        self.s, self.r = settings, random.Random(settings.seed)

    def pick(self, weighted: tuple) -> str:
        return self.r.choices([k for k, _ in weighted], [w for _, w in weighted])[0]

    def business(self, country: str, name: str | None = None) -> Business:
        m, r = MARKETS[country], self.r
        if name is None:
            name = r.choice(m.chains) if r.random() < self.s.chain_share else " ".join(filter(None, (r.choice(m.first), r.choice(m.second), r.choice(m.legal))))
        city = r.randrange(len(m.cities))
        tail = 5 - len(m.cities[city][2]) if country != "in" else 3
        return Business(country, name, str(r.randint(1, 19_999 if country == "us" else 400)), r.choice(m.streets), r.randrange(len(m.kinds)), city, m.cities[city][2] + f"{r.randint(1, 40):0{tail}d}")

    def distractor(self, b: Business) -> Business:
        """Another business that is easily taken for ``b``."""
        kind, other = self.pick(self.s.distractors), self.business(b.country)
        if kind == "sibling":
            return replace(other, name=b.name) if self.r.random() < 0.5 else replace(b, number=other.number)
        if kind == "neighbour":
            return replace(b, name=other.name)
        if kind == "near_name":
            words = b.name.split()
            words[self.r.randrange(len(words))] = self.r.choice(other.name.split())
            return replace(b, name=" ".join(words), number=other.number)
        return other

    def typo(self, text: str) -> str:
        words = text.split()
        long = [i for i, w in enumerate(words) if len(w) >= 4 and w.isalpha()]
        if not long:
            return text
        i = self.r.choice(long)
        w, k = words[i], self.r.randrange(1, len(words[i]) - 1)
        change = self.r.randrange(4)
        words[i] = (w[:k] + w[k + 1 :], w[:k] + self.r.choice("aeinrst") + w[k:], w[:k] + self.r.choice("aeinrst") + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :])[change]
        return " ".join(words)

    def noisy_name(self, name: str, level: float) -> str:
        for _ in range(min(4, int(self.r.expovariate(1 / level)))):
            change = self.r.randrange(6)
            if change == 0:
                for a, b in TWO_FORMS:
                    name = name.replace(a, b) if self.r.random() < 0.7 else name
            elif change == 1:
                name = self.typo(name)
            elif change == 2:
                name = self.r.choice((name.upper(), name.lower(), name.replace("'", "")))
            elif change == 3 and len(name.split()) > 2:
                name = " ".join(name.split()[:-1])
            elif change == 4 and len(name.split()) > 2:
                words = name.split()
                words[0], words[1] = words[1], words[0]
                name = " ".join(words)
            elif change == 5:
                name = f"{name} {self.r.choice(MARKETS['us'].legal)}".strip()
        return name

    def address(self, b: Business, level: float) -> str:
        m = MARKETS[b.country]
        city, state, _ = m.cities[b.city]
        long, short = m.kinds[b.kind]
        word = short if level and self.r.random() < 0.3 else long
        street = f"{b.number} {word} {b.street}" if b.country == "fr" else f"{b.number} {b.street} {word}"
        parts, postal = [street, city, state, b.postal], b.postal
        for _ in range(min(5, int(self.r.expovariate(1 / level))) if level else 0):
            change = self.r.randrange(5)
            if change == 0:
                parts = [p for p in parts if p != postal]
            elif change == 1 and len(parts) > 2:
                parts.pop(self.r.randrange(1, len(parts)))
            elif change == 2:
                parts[0] = self.typo(parts[0])
            elif change == 3:
                parts.insert(self.r.randrange(len(parts) + 1), self.r.choice(("Near Clock Tower", "Opp. Bus Stand", "Suite 4")))
            else:
                self.r.shuffle(parts)
        if level and self.r.random() < self.s.partial_address:
            parts = parts[: self.r.randint(0, 1)]
        return ", ".join(filter(None, parts))

    def country(self, code: str) -> str:
        m, u = MARKETS[code], self.r.random()
        if u < self.s.country_missing:
            return ""
        return self.r.choice(m.aliases) if u < self.s.country_missing + self.s.country_alias else m.label

    def split(self) -> dict[str, list[tuple[str, ...]]]:
        """Rows of the three sources and the matches."""
        s1, found, sources = [], {}, {"S2": [], "S3": []}
        for i in range(self.s.n):
            b = self.business(self.pick(self.s.countries))
            own = f"S1-{i}"
            s1.append((own, b.name, self.address(b, 0.0), self.country(b.country)))
            found[own] = []
            for real in [True] * self.r.choices(range(len(self.s.matches)), self.s.matches)[0] + [False]:
                source = self.r.choice(("S2", "S3"))
                shown, level = (b if real else self.distractor(b)), self.s.noise[source == "S3"]
                sources[source].append((own if real else None, (self.noisy_name(shown.name, level), self.address(shown, level), self.country(shown.country))))
        out = {"S1": s1}
        for source, rows in sources.items():
            self.r.shuffle(rows)
            out[source] = [(f"{source}-{k}", *record) for k, (_, record) in enumerate(rows)]
            for k, (own, _) in enumerate(rows):
                if own:
                    found[own].append(f"{source}-{k}")
        self.r.shuffle(out["S1"])
        out["truth"] = [(own, ",".join(found[own])) for own, *_ in out["S1"]]
        return out


def _write(path: str, header: tuple[str, ...], rows: list[tuple[str, ...]]) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.writelines("\t".join(row) + "\n" for row in [header, *rows])


def write_dataset(folder: str, n_train: int = 3000, n_test: int = 1500, seed: int = 7) -> None:
    """A train split, and a test split with a country that train lacks; its matches go to a file of their own."""
    splits = {"train": Settings(n=n_train, seed=seed), "test": Settings(n=n_test, seed=seed + 1000, countries=(("us", 0.35), ("in", 0.35), ("fr", 0.30)))}
    for name, settings in splits.items():
        rows = Generator(settings).split()
        for i, source in enumerate(("S1", "S2", "S3"), 1):
            _write(f"{folder}/{name}/{name}_source{i}.tsv", RECORD_COLUMNS, rows[source])
        truth = f"{name}_ground_truth.tsv" if name == "train" else "hidden_test_ground_truth.tsv"
        _write(f"{folder}/{name}/{truth}", TRUTH_COLUMNS, rows["truth"])
