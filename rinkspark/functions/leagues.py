"""Names of leagues brought to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of leagues.
LEAGUE_NAMES = {
    "SM-liiga": "Liiga", "Swe-1": "HockeyAllsvenskan", "SweHL": "SHL", "Allsvenskan": "HockeyAllsvenskan", "Allsv": "HockeyAllsvenskan",
    "H-East": "NCAA", "H-EAST": "NCAA", "HE": "NCAA", "Hockey East": "NCAA", "WCHA": "NCAA", "Big-10": "NCAA", "B1G": "NCAA", "Big Ten": "NCAA",
    "BIG10": "NCAA", "CCHA": "NCAA", "AHA": "NCAA", "ECAC": "NCAA", "NCHC": "NCAA", "USNTDP": "USHL", "NTDP": "USHL", "NTDP - USHL": "USHL",
    "USDP": "USHL", "U.S. NTDP": "USHL", "U.S. National Under-18 Team": "USHL", "U.S. National U18 Team": "USHL", "Rus-MHL": "MHL", "Rus-VHL": "VHL",
    "Russia Jrs.": "Russia Jr.", "RUSSIA-JR.": "Russia Jr.", "Russia Junior": "Russia Jr.", "Russian Junior": "Russia Jr.", "Russia Jr": "Russia Jr.",
    "Russia U20": "Russia Jr.", "Swe-Jr": "Sweden Jrs.", "SWEDEN-JR.": "Sweden Jrs.", "Swe-Jr.": "Sweden Jrs.", "Sweden Jr.": "Sweden Jrs.",
    "Sweden U20": "Sweden Jrs.", "J20 Nationell": "Sweden Jrs.", "Nationell": "Sweden Jrs.", "J20": "Sweden Jrs.", "J20 SuperElit": "Sweden Jrs.",
    "SuperElit": "Sweden Jrs.", "Fin-Jr": "Finland Jrs.", "FINLAND-JR.": "Finland Jrs.", "Fin-Jr.": "Finland Jrs.", "Finland Jr.": "Finland Jrs.",
    "U20 SM-sarja": "Finland Jrs.", "U20 SM-liiga": "Finland Jrs.", "Jr. A SM-liiga": "Finland Jrs.", "Czech Jr.": "Czech Jrs.",
    "Czech U20": "Czech Jrs.", "Czechia U20": "Czechia Jrs.", "Slovakia Jr.": "Slovakia Jrs.", "Slovakia U20": "Slovakia Jrs.",
    "Slovak U20": "Slovakia Jrs.", "Swiss Jr.": "Switzerland Jrs.", "Swiss U20": "Switzerland Jrs.", "U20-Elit": "Switzerland Jrs.",
    "Germany U20": "Germany Jrs.", "German Jr.": "Germany Jrs.", "Austria Jr.": "Austria Jrs.", "Belarus Jr.": "Belarus Jrs.",
    "NL": "National League", "NLA": "National League", "Swiss": "National League", "Swiss-2": "Swiss League",
    "Allsvenskan Norra": "HockeyAllsvenskan", "Allsvenskan Sodra": "HockeyAllsvenskan", "SWEDEN-2": "HockeyAllsvenskan", "Slovak": "Slovakia",
    "Czechia": "Czech", "Czechia Extraliga": "Czech Extraliga", "Czech Extraliga": "Czech Extraliga", "MHL-B": "MHL", "VHL-B": "VHL",
    "OHL Cup": "OHL", "WHL Cup": "WHL", "QMJHL Cup": "QMJHL", "USHS-MN": "High School", "USHS-Prep": "Prep School", "Ont. H.S.": "High School",
    "HIGH-MA": "High School", "HIGH-MN": "High School", "J18 Regional": "Sweden Jrs.", "U20 Region": "Sweden Jrs.",
}


def league_name(league: Column) -> Column:
    """The league's usual name: as written, else without case; unknown names stay, blanks and nulls are ``Unknown``."""
    text = F.trim(F.regexp_replace(F.coalesce(league, F.lit("")), "\\s+", " "))
    lower = {}
    for name, usual in LEAGUE_NAMES.items():
        lower[name.lower()] = usual
    as_map = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(text == "", "Unknown").otherwise(F.coalesce(F.try_element_at(as_map(LEAGUE_NAMES), text), F.try_element_at(as_map(lower), F.lower(text)), text))
