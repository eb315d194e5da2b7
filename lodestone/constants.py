"""Word lists, lookup tables, patterns, limits and messages that results depend on."""

from __future__ import annotations

# --- fixed values: limits ---------------------------------------------------------------------------------------------
CHUNK_SIZE = 300
CHUNK_OVERLAP = 30
EMBED_BATCH = 32
MIN_MEANINGFUL_TOKENS = 40
MIN_SECTION_TOKENS = 80
DEDUPE_MIN_TOKENS = 8
DEDUPE_CONTAINER_TOKENS = 12
HEADING_MAX_WORDS = 10
NUMBERED_HEADING_MAX_WORDS = 6
HEADING_TITLE_SHARE = 0.5
PARAGRAPH_MIN_WORDS = 15
LINK_FRAGMENT_MAX_WORDS = 10
DENSE_TOP_K = 15
BM25_TOP_K = 15
RRF_K = 60
FINAL_TOP_K = 4
CONFIDENCE_THRESHOLD = 0.1
OVERFETCH = 4
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
LINE_TOLERANCE, BIN_WIDTH, MIN_GUTTER_WIDTH, MIN_COLUMN_WIDTH = 3.0, 4.0, 12.0, 50.0
SNIPPET_CHARS = 220
HIGH_CONFIDENCE, PARTIAL_CONFIDENCE = 0.7, 0.3
LENGTH_EDGES = (0, 50, 100, 200, 300, 400, 500, 10000)
MIN_REASONABLE_TOKENS, MAX_REASONABLE_TOKENS = 30, 450
SCORE_WATCH = 0.30
FAIL_BAR, WARN_BAR = 0.50, 0.70

# --- fixed values: messages and formats -------------------------------------------------------------------------------
LOW_CONFIDENCE_MESSAGE = "I could not find reliable information in the local emergency knowledge base."
EMPTY_FILTER_MESSAGE = "No chunks match the requested filter."
PROMPT_HEAD = "Context (most safety-critical first):"
PROMPT_TAIL = "\nAnswer with [n] citations. Lead with any safety warning that applies."

# --- fixed values: tags by file name ----------------------------------------------------------------------------------
GENERAL = "general"
TAGS_BY_SLUG = {
    "ready_gov_": {
        "earthquakes": "earthquake", "tsunamis": "tsunami", "floods": "flood", "wildfires": "wildfire",
        "hurricanes": "hurricane", "tornadoes": "tornado", "volcanoes": "volcano", "landslides": "landslide",
        "thunderstorms": "thunderstorm", "avalanche": "avalanche", "drought": "drought", "extreme_heat": "extreme_heat",
        "winter_weather": "winter_weather", "space_weather": "space_weather", "severe_weather": "severe_weather",
        "pandemic": "pandemic", "biohazard": "biohazard", "radiation": "radiation", "explosions": "explosion",
        "household_chemicals": "household_chemicals", "home_fires": "home_fire", "power_outages": "power_outage",
        "mass_gatherings": "mass_gathering", "cybersecurity": "cybersecurity", "plan": "general", "kit": "general",
        "shelter": "general", "evacuation": "general", "recovering": "general", "home_safety": "general",
    },
    "red_cross_": {"disaster_preparedness_plan": "general", "how_to_prepare_for_emergencies": "general", "survival_kit": "general"},
    "wa_emd_": {"tsunami": "tsunami", "hazard_mitigation": "general", "hazard_mitigation_grants": "general"},
}
TAGS_BY_PDF = {
    "2-Weeks-Ready-Community-Brochure-04-Digital.pdf": "general",
    "2-Weeks-Ready-Community-Brochure-Build-Kits.pdf": "general",
    "2-Weeks-Ready-Individual-Family-Brochure-02-Digital-ENGLISH).pdf": "general",
    "When-an-Earthquake-Strikes.pdf": "earthquake",
}
OVERRIDE_PHRASES = {
    "earthquake": ("drop, cover, and hold", "drop and cover", "during a quake", "during the shaking", "actions to take during a quake", "great washington shakeout"),
}

# --- fixed values: synonyms, by tag, in order of precedence -----------------------------------------------------------
SYNONYMS = {
    "earthquake": ("quake", "tremor", "seismic"),
    "wildfire": ("forest fire", "brush fire", "bushfire"),
    "tornado": ("twister", "funnel cloud"),
    "tsunami": ("tidal wave",),
    "hurricane": ("cyclone", "typhoon", "tropical storm"),
    "power_outage": ("blackout", "no power", "lost power"),
    "home_fire": ("house fire",),
    "extreme_heat": ("heat wave", "heatwave", "heatstroke", "heat stroke"),
    "winter_weather": ("blizzard", "ice storm", "snowstorm"),
    "flood": ("flash flood", "flooding"),
}

# --- fixed values: safety phrases -------------------------------------------------------------------------------------
SAFETY_PHRASES = (
    "do not", "don't", "never", "avoid", "stay away",
    "warning", "danger", "dangerous", "hazardous", "caution",
    "immediately", "leave immediately", "get out",
    "evacuate", "evacuation",
    "call 9-1-1", "9-1-1",
    "life-threatening", "deadly", "lethal", "death",
    "shelter in place", "take shelter", "seek shelter", "away from windows", "high ground",
    "drop, cover", "drop and cover",
    "stay low", "get low", "crawl",
    "do not drive", "turn around",
    "turn off", "shut off", "unplug",
)

# --- fixed values: phrases that chunks must keep whole ----------------------------------------------------------------
CRITICAL_PHRASES = ("drop, cover", "hold on", "two weeks", "2 weeks", "go bag", "shelter in place", "evacuation route", "emergency alert")

# --- fixed values: line rules of the three scrape dialects ------------------------------------------------------------
URL_LINE = r"^https?://\S+\s*$"
READ_TIME = r"(?i)^\d+\s+min\s+read$"
MARKDOWN_LINKS = (r"__\[([^\]]+)\]\([^)]+\)__", r"\[([^\]]+)\]\([^)]+\)")
TERMINAL = (".", "!", "?", ":")

READY_NOISE = ("Unknown", "feature_mini img", "feature img", "PDF Link Icon", "alert - warning", "Português, Brasil")
READY_LAST_UPDATED = r"^Last Updated:"
READY_BOILERPLATE = r"(?i)please visit FEMA\.gov for up-to-date information on current disaster declarations"
LINK_EXACT = ("Additional Resources", "Partner Resources", "Associated Content", "Videos", "More Info")
LINK_MARKERS = ("(PDF)", "(CDC)", "(EPA)", "(USFA)", "(NFIP)", "(HHS)", "Toolkit", "Graphics", "Social Media", "Partner Resources", "Additional Resources", "Associated Content")

CROSS_AUTHOR = "Unknown"
CROSS_NOISE = (
    "Unknown",
    "Need help? That's why we're here!",
    "Need help? That’s why we’re here!",
    "Habla español? Esté preparado de acuerdo con La Cruz Roja >>",
    "Red Cross and exclamation point",
    'Download the free Emergency app today. Available in English and Spanish. Search "American Red Cross" in your app store or text "GETEMERGENCY" to 90999.',
    "Available in the App Store® or Google PlayTM.",
    "Apple App Store Icon and QR code",
    "Google Play store icon and QR code",
    "Print out the Preparedness Essentials Checklist:",
    "Thank You to Our 2025 National Sponsor",
    "State Farm logo",
    "Map of the U.S.",
    "Girl holds up a home fire escape plan that she worked on",
    "Sister and brother",
    "Family picture, five members",
    "Woman with two dogs and two birds",
    "Pillowcase Project presentation in classroom",
    "CPR instructor teaches student chest compressions",
    "Keepsakes and old toys stored in an attic",
    "Red number one",
    "Red number two",
    "Red number three",
    "Emergency Contact Card",
    "Download Template >>",
    "Get Tips and Advice",
    "Disaster and Emergency Preparedness for Older Adults",
    "Households, Schools and Educators",
    "Prepare Your Workplace for Emergencies",
    "Commuter Safety",
    "Learn How to Preserve Your Memories",
    "number 1 icon",
    "number 2 icon",
    "number 3 icon",
    "number 4 icon",
    "number 5 icon",
)
CROSS_DROP_PREFIXES = (
    "For more information on emergency preparedness, please visit",
    "For more information on getting help during a disaster, please visit",
    "To make a financial donation, please visit",
)
CROSS_DROP_CONTAINS = ("#redcross",)
CROSS_REWRITES = (('""', '"'), ("Google PlayTM", "Google Play"), ("Ready Rating™", "Ready Rating"), ("Ready RatingTM", "Ready Rating"), ("tips tips", "tips"))
CROSS_SHOP = r"(?i)\s*Shop for Survival Kits and other first aid supplies at the Red Cross Store\."

EMD_AUTHOR = "efelle creative"
EMD_ANNOTATION = r"\s*\(\s*(?:Opens (?:an external site )?in a new window|Opens an external site|PDF)\s*\)"
EMD_NOISE = (
    "A logo showing different hazards. It reads Hazard Mitigation Assistance.",
    "Color graphic showing how a tsunami is formed by an underwater earthquake.",
    "A photo of Ocosta Elementary school in Westport, Washington. The two-story gym building has four large corner pillars which form the basis of the vertical evacuation structure.",
    "Connect With Us",
    "BlueSky: @emd.wa.gov",
    "X/Twitter: @waEMD",
    "Facebook: WashEMD",
    "YouTube",
    "Nextdoor",
    "Color graphic showing different ways to get tsunami alerts. Text on the top says “Tsunamis can happen at any time. How will you be alerted? Mil.wa.gov/alerts.”",
    "Tsunami alert levels include warning, advisory, watch, and information statement.",
    "(Opens an external site in a new window)",
    "(Opens in a new window)",
)
EMD_DROP_PREFIXES = ("Questions? Please email", "1. Click on or copy the following link into your browser:", "Learn about hazard mitigation grants at", "Color graphic showing the four tsunami alert levels")
EMD_SPACING = (
    (" ", " "),
    ("\xa0", " "),
    ("atmil.wa.gov", "at mil.wa.gov"),
    ("Copies of those strategies can be found below.", ""),
    (" Download the county-specific VES assessment reports below:", ""),
    ("Download the county-specific VES assessment reports below:", ""),
    ("Below are links to tsunami education resources, including external sites, materials available for download, and educational videos.", "WA EMD provides tsunami education resources, materials available for download, and educational videos."),
    ("To help communities navigate the process, WA EMD has developed a step-by-step guide with lessons from Washington, Oregon, and beyond. Here’s how to get started:", "To help communities navigate the process, WA EMD has developed a step-by-step guide with lessons from Washington, Oregon, and beyond."),
    ("the sirens play a wail sound (click here to listen to what it sounds like ) followed", "the sirens play a wail sound followed"),
    ("the sirens play the Westminster Chimes (click here to listen to what it sounds like ).", "the sirens play the Westminster Chimes."),
)
EMD_CAPTIONS = (
    ("Color graphic showing what to do when on the coast during a large earthquake.", "If you are on the coast during a large earthquake, first drop, cover, and hold on to protect yourself during the ground shaking. Then head inland to high ground; the shaking is your tsunami warning. Stay at high ground because tsunami waves may arrive for hours."),
    ("Black and white graphic showing different factors a mariner should consider", "Mariners should consider vessel capability and speed, vessel draft, provisions and equipment on board, crew skill level, communication services, time before tsunami impact, distance to land or deep water, and weather, tide stage, and sea state."),
)
EMD_SECTIONS = {
    "wa_emd_hazard_mitigation_grants.txt": (
        ("What is Hazard Mitigation?", "What is Hazard Mitigation?"),
        ("To continue receiving funding opportunity communication from us, we ask you to sign up for GovDelivery by following the simple steps below:", "This does not mean that this email, hma@mil.wa.gov is going away; we will still be here to answer questions and discuss specifics. However, no alerts for funding opportunities will be distributed this way moving forward."),
        ("Resources", None),
    ),
    "wa_emd_tsunami.txt": (
        ("Public Education Materials", "Maritime Guidance"),
        ("Port of Port Angeles' Port Angeles Harbor and Sequim Bay", "Tsunami Vertical Evacuation"),
        ("A Guide to Tsunami Vertical Evacuation Options on the Washington Coast Volume 1: Pacific County-20MB", "Planning a VES? Funding and Resources Explored"),
        ("Download our Manual for Tsunami Vertical Evacuation Structures and supporting documents to learn more about the process:", "Interested in bringing a VES to your community?"),
    ),
}
