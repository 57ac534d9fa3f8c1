"""The dictionary of subscription services: a small dimension (44 rows, 83 variants), the same at every data size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id | name | category | usual period | variants in normal form. The last three are intermediaries.
SERVICES = """
netflix | Netflix | streaming | monthly | NETFLIX
disney-plus | Disney+ | streaming | monthly | DISNEY+, DISNEY PLUS, DISNEYPLUS
prime-video | Amazon Prime | streaming | unknown | AMAZON PRIME, AMZN PRIME, PRIME VIDEO, PRIMEVIDEO
canal-plus | Canal+ | streaming | monthly | CANAL+, CANAL PLUS, CANALPLUS, GROUPE CANAL
apple-tv-plus | Apple TV+ | streaming | monthly | APPLE TV+, APPLE TV
hbo-max | HBO Max | streaming | monthly | HBO MAX, HBOMAX
paramount-plus | Paramount+ | streaming | monthly | PARAMOUNT+, PARAMOUNT PLUS
crunchyroll | Crunchyroll | streaming | monthly | CRUNCHYROLL
dazn | DAZN | streaming | monthly | DAZN
bein-sports | beIN SPORTS | streaming | monthly | BEIN SPORTS, BEIN SPORT
youtube-premium | YouTube Premium | streaming | monthly | YOUTUBE PREMIUM, YOUTUBEPREMIUM, GOOGLE YOUTUBE
spotify | Spotify | musique | monthly | SPOTIFY
deezer | Deezer | musique | monthly | DEEZER
apple-music | Apple Music | musique | monthly | APPLE MUSIC
icloud | iCloud+ | stockage | monthly | ICLOUD, ICLOUD+
google-one | Google One | stockage | unknown | GOOGLE ONE, GOOGLE STORAGE
dropbox | Dropbox | stockage | unknown | DROPBOX
le-monde | Le Monde | presse | monthly | LE MONDE, LEMONDE
le-figaro | Le Figaro | presse | monthly | LE FIGARO, FIGARO
mediapart | Mediapart | presse | monthly | MEDIAPART
lequipe | L'Équipe | presse | monthly | L EQUIPE, LEQUIPE
audible | Audible | presse | monthly | AUDIBLE
basic-fit | Basic-Fit | sport | unknown | BASIC FIT, BASICFIT
fitness-park | Fitness Park | sport | unknown | FITNESS PARK, FITNESSPARK
orange | Orange | telephonie | monthly | ORANGE
sosh | Sosh | telephonie | monthly | SOSH
sfr | SFR | telephonie | monthly | SFR
red-by-sfr | RED by SFR | telephonie | monthly | RED BY SFR, REDBYSFR
bouygues-telecom | Bouygues Telecom | telephonie | monthly | BOUYGUES TELECOM, BOUYGUES TEL, BYTEL
free | Free | telephonie | monthly | FREE MOBILE, FREE TELECOM, FREEBOX
b-and-you | B&You | telephonie | monthly | B&YOU, B AND YOU, BANDYOU
navigo | Navigo / Imagine R | transport | monthly | PASS NAVIGO, NAVIGO, IMAGINE R, IMAGIN R
chatgpt | ChatGPT | applis | monthly | OPENAI, CHATGPT
adobe | Adobe | applis | unknown | ADOBE
microsoft-365 | Microsoft 365 | applis | unknown | MICROSOFT 365, MICROSOFT365, OFFICE 365
playstation-plus | PlayStation Plus | applis | unknown | PLAYSTATION, PLAYSTATION NETWORK, SONY INTERACTIVE
xbox | Xbox Game Pass | applis | unknown | XBOX, XBOX GAME PASS
nintendo-switch-online | Nintendo Switch Online | applis | unknown | NINTENDO
duolingo | Duolingo | applis | unknown | DUOLINGO
uber-one | Uber One | applis | monthly | UBER ONE
deliveroo-plus | Deliveroo Plus | applis | monthly | DELIVEROO PLUS
apple | Apple | applis | unknown | APPLE.COM BILL, APPLE COM BILL, APPLE.COM
google-play | Google Play | applis | unknown | GOOGLE PLAY
paypal | PayPal | autre | unknown | PAYPAL
"""
INTERMEDIARIES = ("apple", "google-play", "paypal")
# French names of the enumerations.
CATEGORY_LABELS = {
    "streaming": "Streaming", "musique": "Musique", "stockage": "Stockage en ligne", "presse": "Presse et lecture", "sport": "Salle de sport", "telephonie": "Téléphonie et box",
    "assurance": "Assurances", "banque": "Options bancaires", "applis": "Applis et jeux", "essai": "Essais gratuits", "transport": "Transports", "autre": "Autres",
}
PERIOD_LABELS = {"weekly": "par semaine", "monthly": "par mois", "quarterly": "par trimestre", "yearly": "par an", "unknown": "fréquence à préciser"}
STATUS_LABELS = {"keep": "Je garde", "to_cancel": "À résilier", "cancelled": "Résilié"}
CONFIDENCE_LABELS = {"high": "Sûr", "medium": "Probable", "low": "À confirmer"}
# The memory checklist, and its examples without a brand.
CHECKLIST = ("streaming", "musique", "stockage", "presse", "sport", "telephonie", "assurance", "banque", "applis", "essai")
GENERIC = {
    "assurance": ("Mutuelle", "Assurance habitation", "Assurance auto", "Assurance téléphone"),
    "banque": ("Carte bancaire premium", "Assurance moyens de paiement", "Frais de tenue de compte"),
    "sport": ("Salle de sport", "Club de sport"),
}
SCHEMA = "service_ord int, service_id string, service_name string, service_category string, usual_period string, intermediary boolean, variants array<string>, cancel_url string, verified boolean"


def services(spark: SparkSession) -> DataFrame:
    rows = []
    for order, line in enumerate(SERVICES.strip().splitlines()):
        key, name, category, period, variants = (x.strip() for x in line.split(" | "))
        rows.append((order, key, name, category, period, key in INTERMEDIARIES, variants.split(", "), "", False))
    return spark.createDataFrame(rows, SCHEMA)


def label_of(value: Column, names: dict[str, str]) -> Column:
    """The French name of an enumeration's value; null for others."""
    return reduce(lambda chain, x: chain.when(value == x[0], F.lit(x[1])), names.items(), F)
