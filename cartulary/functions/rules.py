"""Rules as data: patterns, needles and labels, compiled to Column expressions by ``text``.

The lists below are fixed values: they must equal the established taxonomy for
results to agree, so they stand as plain text in their natural order.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
NULL_TOKENS = ("", "nan", "none", "null")

REGION_STATES = {
    "northeast": ("ct", "me", "ma", "nh", "ri", "vt", "nj", "ny", "pa"),
    "midwest": ("il", "in", "mi", "oh", "wi", "ia", "ks", "mn", "mo", "ne", "nd", "sd"),
    "south": ("de", "fl", "ga", "md", "nc", "sc", "va", "dc", "wv", "al", "ky", "ms", "tn", "ar", "la", "ok", "tx"),
    "west": ("az", "co", "id", "mt", "nv", "nm", "ut", "wy", "ak", "ca", "hi", "or", "wa"),
}

PLACE_PREFIX = r"(?:the\s+)?(?:county of|city of|village of|township of|town of|borough of|parish of|county|city|village|township|town|borough|parish)\s+"
PLACE_SUFFIX = r"\s+(?:county|city|village|township|town|borough|parish)"

MOTIVE_NEEDLES = {
    "externality_control": ("nuisance", "noise", "smoke", "odor", "hazard", "congestion", "incompatible uses"),
    "exclusion": ("single-family", "residential character", "noxious", "separate uses", "exclusive"),
    "value_capture": ("property values", "value of buildings", "value of land", "tax base"),
    "growth_management": ("orderly growth", "development of land", "comprehensive plan", "population", "density"),
    "fiscal_zoning": ("tax", "assessment", "fee", "fees", "rent", "revenue"),
    "public_health_safety": ("health", "safety", "welfare", "fire", "light and air", "danger"),
    "aesthetic_design_control": ("appearance", "aesthetic", "harmony", "landscaping", "sign", "design"),
    "infrastructure_coordination": ("street", "sewer", "water", "utility", "utilities", "schools", "transportation", "public services"),
    "environmental_protection": ("floodplain", "erosion", "wetland", "natural resource", "drainage", "environment"),
}

ACTORS = (
    ("planning_commission", r"\bplanning commission\b"),
    ("city_council", r"\b(city council|board of trustees|board of supervisors)\b"),
    ("zoning_board", r"\b(board of appeals|board of adjustment|zoning board)\b"),
    ("zoning_administrator", r"\b(zoning administrator|building inspector|administrative official)\b"),
    ("property_owner", r"\b(owner|developer|applicant|occupant)\b"),
)
TARGETS = (
    ("lot", r"\blot\b"),
    ("building", r"\b(building|structure)\b"),
    ("use", r"\buse\b"),
    ("district", r"\bdistrict\b"),
    ("sign", r"\bsign\b"),
    ("parking", r"\bparking\b"),
    ("subdivision", r"\b(subdivision|plat)\b"),
)
INSTRUMENTS = (
    ("setback", "setback_standard"),
    ("lot area", "lot_area_standard"),
    ("lot width", "lot_width_standard"),
    ("height", "height_standard"),
    ("parking", "parking_standard"),
    ("conditional use", "conditional_use"),
    ("special exception", "special_exception"),
    ("variance", "variance"),
    ("appeal", "appeal"),
    ("district", "district_framework"),
    ("map", "zoning_map"),
    ("permit", "permit_administration"),
    ("subdivision", "subdivision_standard"),
    ("plat", "plat_approval"),
    ("penalty", "penalty_enforcement"),
    ("nonconforming", "nonconforming_rule"),
    ("definition", "definition"),
    ("purpose", "purpose"),
)
MODALITIES = (
    ("must_not", r"\b(shall not|must not|prohibited|unlawful|no\s+[a-z].+shall)\b"),
    ("definition", r"\b(means|shall mean|is defined as|defined as)\b"),
    ("may", r"\b(may|authorized|permitted to)\b"),
    ("must", r"\b(shall|must|required)\b"),
)
HINTS = (
    ("minimum lot area", "Minimum lot area"),
    ("lot width", "Minimum lot width"),
    ("front yard", "Front setback"),
    ("side yard", "Side setback"),
    ("rear yard", "Rear setback"),
    ("height", "Height limit"),
    ("parking", "Parking requirement"),
    ("loading", "Loading requirement"),
    ("conditional use", "Conditional use"),
    ("special exception", "Special exception"),
    ("variance", "Variance procedure"),
    ("appeal", "Appeal procedure"),
    ("zoning map", "Zoning map change"),
    ("district", "District classification"),
    ("nonconforming", "Nonconforming use"),
    ("subdivision", "Subdivision standard"),
    ("plat", "Plat approval"),
    ("penalty", "Penalty provision"),
    ("enforcement", "Enforcement rule"),
    ("permit", "Permit requirement"),
)
#: (kind, needles of which any must occur, needles that must all occur)
SECTION_KINDS = (
    ("purpose", ("purpose", "intent", "general welfare"), ()),
    ("definitions", ("definition", "means", "shall mean"), ()),
    ("district_map", (), ("district", "map")),
    ("districts", ("district",), ()),
    ("uses", ("permitted use", "uses permitted", "use regulations"), ()),
    ("dimensional", ("setback", "yard", "lot area", "lot width", "height", "parking", "loading"), ()),
    ("appeals_variances", ("variance", "appeal", "board of adjustment", "board of appeals"), ()),
    ("administration", ("permit", "application", "site plan", "conditional use", "special exception"), ()),
    ("enforcement", ("penalty", "violation", "enforcement", "fine", "unlawful"), ()),
    ("subdivision", ("subdivision", "plat"), ()),
    ("closing", ("severability", "effective date"), ()),
)
CONDITION = r"\b(if|unless|provided that|when)\b(.+?)(?:[.;]|$)"
EXCEPTION = r"\b(except|provided however|but)\b(.+?)(?:[.;]|$)"
PURPOSE = r"\b(purpose|intent|policy)\b"
PREAMBLE = r"^\s*(whereas|be it ordained|it is the purpose|it is the intent)\b"
MAP_BOUNDARY = r"\b(beginning at|thence|boundary line|boundary lines|center line|official zoning map|shown upon the map|metes and bounds)\b"
BOILERPLATE = r"\b(short title|effective date|severability|repeal(?:er)?|publication|this ordinance shall take effect|ordinance number)\b"
PROCEDURAL_INSTRUMENTS = ("permit_administration", "appeal", "variance", "conditional_use", "special_exception", "plat_approval", "subdivision_standard", "zoning_map")
NUMBERS = {
    "minimum_lot_area": r"\b(?:minimum\s+)?lot\s+(?:area|size).{0,30}?(\d[\d,]*(?:\.\d+)?)\s*(sq\.?\s*ft\.?|square feet|acres?)",
    "minimum_lot_width": r"\blot\s+width.{0,24}?(\d[\d,]*(?:\.\d+)?)\s*(feet|ft\.?)",
    "front_setback": r"\bfront\s+yard.{0,24}?(\d[\d,]*(?:\.\d+)?)\s*(feet|ft\.?)",
    "side_setback": r"\bside\s+yard.{0,24}?(\d[\d,]*(?:\.\d+)?)\s*(feet|ft\.?)",
    "rear_setback": r"\brear\s+yard.{0,24}?(\d[\d,]*(?:\.\d+)?)\s*(feet|ft\.?)",
    "height_limit": r"\bheight.{0,24}?(\d[\d,]*(?:\.\d+)?)\s*(feet|ft\.?|stories)",
    "parking_spaces": r"\bparking.{0,24}?(\d[\d,]*(?:\.\d+)?)\s*(spaces?|stalls?)",
    "penalty_amount": r"\b(?:fine|penalty).{0,18}?\$?(\d[\d,]*(?:\.\d+)?)()",
}
REFERENCES = {
    "formal_reference_mentions": r"\b(section|sections|article|articles|chapter|chapters|subsection|subsections|paragraph|paragraphs)\s+[0-9ivxlcdm\-]+",
    "dependency_trigger_mentions": r"\b(subject to|except as provided|provided that|in accordance with|pursuant to|notwithstanding|unless otherwise provided|as required by|as provided in|under the provisions of)\b",
    "map_reference_mentions": r"\b(zoning map|official zoning map|district map|map attached|map on file|zoning atlas)\b",
    "board_reference_mentions": r"\b(board of appeals|board of adjustment|plan commission|planning commission|zoning administrator|building inspector|zoning board)\b",
}
ARTICLE_HEADING = r"^(article|chapter)\s+([ivx0-9a-z\-]+)\b"
SECTION_HEADING = r"^(section|sec\.?)\s+([0-9ivxA-Za-z.\-]+)\b"
ENUMERATOR = r"^\(?([0-9]+|[A-Za-z]|[ivxIVX]+)[\).:-]\s+"
CAPS_HEADING = r"""^[A-Z0-9 ,.&'"/\-():;]{4,140}$"""
CLAUSE_MODAL = r"\b(shall not|must not|prohibited|unlawful|shall|must|required|may|permitted|means|defined as|is defined as)\b"
SENTENCE_END = r"""(?<=[.;:])\s+(?=(?:[A-Z(]|"))"""
ACTION_TAGS = {
    "adoption": (r"\b(adopt|adoption|adopted)\b", r"\b(be it ordained|ordained and enacted)\b"),
    "amendment": (r"\b(amend|amends|amended|amendment)\b", r"\b(ordinance\s+no\.?\s*\\d+).*\\b(amend)"),
    "rezoning_map_change": (r"\b(rezone|rezoning|re-zoning)\b", r"\b(reclassif(y|ication)|reclassification)\b", r"\b(zoning\s+map)\b", r"\b(change\s+of\s+zone|zone\s+change)\b"),
    "public_hearing_notice": (r"\b(notice\s+of\s+(public\s+)?hearing)\b", r"\b(public\s+hearing)\b", r"\b(planning\s+commission)\b"),
    "variance_special_exception": (r"\b(variance|variances)\b", r"\b(special\s+exception|special\s+use)\b", r"\b(board\s+of\s+appeals|zoning\s+board)\b"),
    "conditional_use_permit": (r"\b(conditional\s+use|special\s+permit)\b", r"\b(use\s+permit)\b"),
    "enforcement_penalties": (r"\b(violation|violations|unlawful)\b", r"\b(penalt(y|ies)|fine|imprisonment)\b", r"\b(enforcement|enforce)\b"),
    "administration_procedure": (r"\b(permit\s+required|certificate\s+of\s+occupancy)\b", r"\b(zoning\s+administrator|building\s+inspector)\b", r"\b(application\s+shall\s+be\s+filed)\b"),
}
DIMENSION_TAGS = {
    "district_definitions": (r"\b(definitions?)\b", r"\b(districts?)\b", r"\b(zoning\s+district)\b"),
    "permitted_uses": (r"\b(permitted\s+uses?)\b", r"\b(uses?\s+permitted)\b", r"\b(prohibited)\b"),
    "setbacks_yards": (r"\b(setback|setbacks)\b", r"\b(front\s+yard|rear\s+yard|side\s+yard)\b", r"\b(yard\s+requirements?)\b"),
    "lot_size_area": (r"\b(minimum\s+lot\s+(area|size))\b", r"\b(lot\s+area|lot\s+size)\b", r"\b(square\s+feet|sq\.?\s*ft\.?)\b"),
    "height_bulk": (r"\b(height|stories)\b", r"\b(bulk\s+regulations?)\b", r"\b(floor\s+area\s+ratio|far)\b"),
    "density_dwelling_units": (r"\b(density)\b", r"\b(dwelling\s+units?)\b", r"\b(units?\s+per\s+acre)\b"),
    "parking_loading": (r"\b(off-?street\s+parking|parking\s+spaces?)\b", r"\b(loading\s+spaces?|off-?street\s+loading)\b"),
    "signs": (r"\b(signs?|billboards?)\b", r"\b(sign\s+area|sign\s+height)\b"),
    "mobile_homes": (r"\b(mobile\s+home|manufactured\s+home|trailer\s+park)\b", r"\b(mobile\s+home\s+park)\b"),
    "nonconforming": (r"\b(nonconforming|non-conforming)\b", r"\b(grandfather(ed)?|lawful\s+nonconforming)\b"),
    "subdivision_platting": (r"\b(subdivision|platting|plat)\b", r"\b(preliminary\s+plat|final\s+plat)\b"),
    "pud_site_plan": (r"\b(planned\s+unit\s+development|pud)\b", r"\b(site\s+plan)\b"),
}
INSTRUMENT_TAGS = {
    "full_ordinance_text": (r"\b(zoning\s+ordinance)\b", r"\b(article\s+\\d+|section\s+\\d+)\b"),
    "notice_legal_ad": (r"\b(legal\s+notice|notice\s+is\s+hereby\s+given)\b", r"\b(published\s+in\s+the)\b"),
    "hearing_agenda_minutes": (r"\b(agenda|minutes)\b", r"\b(council\s+meeting)\b"),
}
ZONING_CONTEXT = r"\b(zoning|rezon|re-?zoning|ordinance|land\s+use|zoning\s+map|district\s+map|planning\s+commission|board\s+of\s+appeals|zoning\s+board|conditional\s+use|variance|nonconforming|setback|yard\s+requirements?|mobile\s+home|trailer\s+park|parking\s+spaces?|off-?street\s+parking|signs?|billboards?)\b"
DISTRICT_TOKEN = r"\b([rcim]|ag|mf)-\d+[a-z]?\b"
DISTRICT_CODE = r"\b([rcim])\s*-?\s*(\d+)\b"
SIGNALS = {
    "has_be_it_ordained": r"\bbe it ordain(?:ed|s)?\b|\bdoes ordain\b",
    "has_section_clause": r"\b(?:section|sec\.?|§)\s*\d+[A-Za-z0-9.-]*\b",
    "has_amend_formula": r"\bis hereby amended\b|\bamended to read as follows\b|\bamend(?:ing)? section\b",
    "has_effective": r"\bshall take effect\b|\beffective date\b|\bshall become effective\b",
    "has_public_hearing": r"\bpublic hearing\b|\bhearing will be held\b",
    "has_minutes": r"\bminutes\b|\bmotion carried\b|\bapproved the minutes\b",
    "has_notice_copy_available": r"\bcopy (?:may|can) be examined\b|\bavailable for public inspection\b",
    "has_variance_terms": r"\bvariance\b|\bspecial exception\b|\bconditional use\b|\bspecial use\b",
    "has_rezone_terms": r"\brezone\b|\brezoning\b|\bzoning map\b|\bfrom [A-Z0-9-]+ to [A-Z0-9-]+\b",
    "has_building_housing": r"\bbuilding\b|\bhousing\b|\bsetback\b|\blot\b|\bheight\b|\bdensity\b",
}
MISSING_TEXT = r"\[MISSING TEXT[^\]]*\]"
CONTINUED_FROM = r"continued\s+from\s+page\s+\d+"
CONTINUED_ON = r"continued\s+(?:on|to)\s+page\s+\d+"
PAGE_GAP_HINT = r"\bpage\b|\bpages\b|next newspaper page|earlier pages|unavailable|not attached|attached issue page|supplied page images|available issue pages|intervening page|continued on page|continuation from page|continuation on missing newspaper page|not present on the attached issue page"
ANCHOR_WORDS = r"\b(article|section|chapter|part)\b"
# --- end of fixed values ----------------------------------------------------
