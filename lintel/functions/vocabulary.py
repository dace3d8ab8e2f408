"""Fixed values that results depend on: placeholder lists, prefixes, keyword patterns, messages."""

# Texts that stand for "no value", one list for each place that has its own.
UNKNOWN = ["", "-", "--", "---", "----", "—", "N/A", "NA", "NONE", "NULL", "UNKNOWN", "NOT SHOWN", "NOT PROVIDED", "TBD", "?"]
BLANK = ["", "N/A", "NA", "NONE", "NULL", "?", "-", "--", "---", "----"]
BLANK_STATUS = ["", "N/A", "NA", "NONE", "NULL", "?", "-", "—"]
BLANK_REF = ["", "?", "N/A", "NA", "NONE", "NULL", "-", "--", "---", "----"]
BLANK_QA = ["", "N/A", "NA", "NONE", "NULL", "?", "-", "--", "---"]
NO_FIRE_RATING = ["----", "---", "--", "-", "N/A", "NA", "NONE", ""]
NO_QTY = ["", "N/A", "NA", "NONE", "NULL", "LOT", "AS REQ", "AS REQUIRED", "VARIES"]

# Units.
UNITS = {"EA": "EA", "EACH": "EA", "PR": "PAIR", "PAIR": "PAIR", "PRS": "PAIR", "PAIRS": "PAIR", "SET": "SET", "SETS": "SET"}
NO_UNIT = ["", "N/A", "NA", "NONE", "NULL"]

# Words of a door type that make it a pair.
PAIR_WORDS = ["PAIR", " PR ", "(PR)", "PR-", "-PR", "DBL", "DOUBLE"]

# Prefixes of hardware set labels, in the order in which they are tried.
LABEL_PREFIXES = [
    r"hardware\s+group\s+(?:no\.?\s*|#)?", r"hardware\s+set\s*(?:#|no\.?)?\s*", r"hw\s*set\s*(?:#|no\.?)?\s*", r"hw\s*group\s*(?:#|no\.?)?\s*",
    r"door\s+schedule\s+id\s*", r"door\s+schedule\s+set\s*", r"door\s+schedule\s+group\s*", r"door\s+schedule\s*", r"door\s+set\s*", r"door\s+group\s*", r"door\s+id\s*",
    r"opening\s+id\s*", r"opening\s+set\s*", r"opening\s+group\s*", r"opening\s+no\.?\s*", r"set\s+(?:no\.?\s*|#)?", r"group\s+(?:no\.?\s*|#)?", r"fhw[-\s]?", r"hw[-\s]?", r"#",
]
KEY_PREFIXES = [
    r"hardware\s+group\s+(?:no\.?\s*)?", r"hardware\s+set\s*(?:#|no\.?)?\s*", r"hw\s*set\s*(?:#|no\.?)?\s*", r"set\s+(?:no\.?\s*)?", r"group\s+(?:no\.?\s*)?", r"fhw[-\s]?", r"hw[-\s]?", r"#",
]
PLACEHOLDER_COMPACT = ["", "-", "NA", "N/A", "NONE", "NULL", "NO", "NIC", "TBD", "VARIES", "EVARIES", "EXIST", "EXISTING"]
PLACEHOLDER_TEXT = ["-", "--", "—", "<VARIES>", "(E)", "E", "DOOR HARDWARE", "HARDWARE", "HARDWARE SET", "HARDWARE SETS", "MANUF.", "MANUFACTURER", "TWO ACCESSORIES"]

# Keyword patterns of the component test.
COMPONENT_WORDS = (
    r"\b(?:HINGE|BUTT|PIVOT|CLOSER|LOCK|LOCKSET|LATCH|LATCHSET|MORTISE|CYLINDER|DEADBOLT|DEADLOCK|STRIKE|THRESHOLD|WEATHER\s*STRIP|WEATHERSTRIP|SEAL|GASKET|"
    r"KICK\s*PLATE|KICKPLATE|PUSH\s*PLATE|PULL\s*PLATE|STOP|SILENCER|PANIC|EXIT\s*DEVICE|COORDINATOR|FLUSH\s*BOLT|SURFACE\s*BOLT|BOLT|OVERHEAD\s*STOP|POWER\s*TRANSFER|"
    r"ELECTRIC\s*STRIKE|ASTRAGAL|HOLDER|VIEWER|OPERATOR|CLOSING\s*DEVICE)\b"
)
SCHEDULE_NOISE = (
    r"\b(?:DOOR\s+SCHEDULE|WINDOW\s+SCHEDULE|HARDWARE\s+SCHEDULE|SEE\s+HARDWARE|REFER\s+TO\s+HARDWARE|PROJECT\s+NO|DRAWN\s+BY|CHECKED\s+BY|SHEET\s+NO|REVISION|GENERAL\s+NOTES?|"
    r"TITLE\s+BLOCK|ARCHITECT|ENGINEER|SCALE|DATE|ROOM\s+NAME|DOOR\s+NO|DOOR\s+NUMBER|FRAME\s+TYPE|FIRE\s+RATING|FINISH\s+TAG|EQUIPMENT\s*/\s*FIXTURE|LEGEND|GLASS\s+PANEL|"
    r"SALVAGED\s+DOOR|HOLLOW\s+METAL\s+DOOR\s*/\s*FRAME|DOOR\s*&\s*FRAME\s+TO\s+BE\s+PAINTED|PRIME\s*&\s*PAINT\s+DOOR\s*&\s*FRAME|FIELD\s+VERIFY|WINDOW\s+ALTERNATES?)\b"
)
EQUIPMENT_NOISE = (
    r"\b(?:TV|TELEVISION|ORGANIZER|TRASH\s+CAN|GLOVE\s+BOX|SHARPS|HEIGHT\s+MEASURER|GRAB\s+BARS?|HAND\s+SANITIZER|SOAP\s+DISPENSER|PAPER\s+TOWEL|TOILET\s+PAPER|CORK\s+BOARD|"
    r"UTILITY\s+PLASTIC\s+CART|OTOSCOPE|SPECULA|MIRROR|ADA\s+SIGNAGE|HIGH\s+TABLE|WATER\s+DISPENSER|REFRIGERATOR|FREEZER|UNDER\s+CABINET|CHAIR|EQUIPMENT|FIXTURE|FURNITURE|APPLIANCE)\b"
)
ACCESS_NOISE = r"\b(?:CARD\s+READER(?:\s+ACCESS)?|ACCESS\s+CONTROL|A\.?\s*C\.?\s+(?:CONTROL|MONITOR)|KEY\s*CARD|DOOR\s+CONTACT|REX\s+SENSOR)\b"
FINISH_NOISE = (
    r"\b(?:ROOM\s+FINISH\s+SCHEDULE|FINISH\s+SCHEDULE|FLOOR\s+FINISH|WALL\s+FINISH|CEILING\s+FINISH|FINISH\s+PLAN)\b|"
    r"^(?:CPT|CT|PNT|PT|RWB|RB|VCT|LVT|ACT|GWB)(?:\s*/\s*(?:CPT|CT|PNT|PT|RWB|RB|VCT|LVT|ACT|GWB))*$"
)
MADE_UP_MAKERS = r"^(?:ABC|XYZ|DEF|GHI|JKL|MNO|PQR|STU)(?:\s+(?:CORP|INC|LTD|LLC|CO))?$"
SET_TITLE = r"^(?:DOOR\s+HARDWARE\s+)?(?:HARDWARE\s+)?(?:SET|GROUP)\s*(?:NO\.?|#)?\s*[A-Z0-9_.-]+$"
HEADINGS = [
    "DESCRIPTION", "COMPONENT", "ITEM", "QTY", "QUANTITY", "UNIT", "FINISH", "MFR", "MANUFACTURER", "CATALOG", "CATALOG NUMBER", "HARDWARE", "HARDWARE SET", "HARDWARE GROUP",
    "SEE HARDWARE SCHED", "SEE HARDWARE SCHEDULE",
]
ROOM_NAMES = [
    "RESTROOM", "KITCHEN", "OFFICE", "BREAK", "BREAKROOM", "BREAK RM", "STORAGE", "CORRIDOR", "HALL", "LOBBY", "VESTIBULE", "TOILET", "MECH", "MECHANICAL", "ELECTRICAL", "JANITOR",
    "CLOSET", "EXTERIOR DOORS", "INTERIOR DOORS",
]
NO_SET_ID = ["", "?", "HARDWARE", "HARDWARE SCHEDULE", "SCHEDULE"]
NOTE_STARTS = ["SEE ", "REFER ", "NOTE:", "NOTES:", "GENERAL NOTE"]
DOOR_MARK = r"^(?:[A-Z]{0,4}[-_.]?\d{1,5}[A-Z0-9_.-]*|\d{1,4}[A-Z]?)$"

# Patterns of page evidence.
DOOR_NUMBER = r"(?<![A-Za-z0-9])\[?[A-Za-z]{0,3}\d{2,4}[A-Za-z]?\]?(?![A-Za-z0-9])"
DIMENSION = "\\d+\\s*['’]\\s*-?\\s*\\d+(?:\\s+\\d+/\\d+)?\\s*(?:\"|”)?"
CAD_SIZE = r"\b\d{3,4}\s*[xX]\s*\d{3,4}\b"
SET_HEADER = (
    r"(?i)(?:^|\n)\s*(?:HARDWARE\s+SETS?|HARDWARE\s+GROUP|HDWE\s+SET|HDWR\s+SET|HDW\s+SET|HW\s+SET|SET\s*NO\.?|GROUP\s*NO\.?|HARDWARE\s+NO\.?|HW\s*[#\-]?\s*[\w.-]+|"
    r"SET\s*[#\-]?\s*[\w.-]+|GROUP\s*[#\-]?\s*[\w.-]+)\s*[\.:\-]?\s*[\w\d\-]*"
)
PAGE_COMPONENT = (
    r"(?i)\b(?:HINGE|BUTT|PIVOT|CLOSER|LOCKSET|LATCHSET|MORTISE|CYLINDER|DEADLOCK|DEADBOLT|STRIKE|THRESHOLD|WEATHER\s*STRIP|WEATHERSTRIP|KICK\s*PLATE|DOOR\s*STOP|FLOOR\s*STOP|"
    r"WALL\s*STOP|SMOKE\s*SEAL|GASKET|SILENCER|PANIC|EXIT\s*DEVICE|COORDINATOR|FLUSH\s*BOLT|SURFACE\s*BOLT|OVERHEAD\s*STOP|POWER\s*TRANSFER|ELECTRIC\s*STRIKE|PUSH\s*PLATE|"
    r"PULL\s*PLATE|DOOR\s*HOLDER|ASTRAGAL|AUTO(?:MATIC)?\s*OPERATOR|VIEWER)\b"
)
PAGE_HEADER = (
    r"(?i)\b(?:DOOR\s+SCHEDULE|OPENING\s+SCHEDULE|HARDWARE\s+SCHEDULE|DOOR\s+NO\.?|DOOR\s+NUMBER|DOOR\s+MARK|DOOR\s+TYPE|RM\s+NAME|DR\s*#|FRAME\s+TYPE|FRAME\s+MATERIAL|"
    r"FIRE\s+RATING|HDWR\s+SET|HDWE\s+SET|HDW\s+SET|HARDWARE\s+SET|HARDWARE\s+GROUP)\b"
)
PAGE_TITLE = (
    r"(?i)\b(?:PROJECT\s+NO|PROJECT\s+LOCATION|DRAWN\s+BY|CHECKED\s+BY|SHEET\s+(?:NO|NUMBER)|PHONE\s*:|WWW\.|ARCHITECTS?|REVISIONS?\b|FIRST\s+ISSUED\s+ON|STREET|SUITE|ZIP|CITY,?\s*STATE)\b"
)
CID = r"\(cid:\d+\)"
BROKEN_COLUMNS = [r"(?i)\bDOO\s*\|\s*R\b", r"(?i)\bSCH\s*\|\s*EDULE\b", r"(?i)\bNUM\s*\|\s*BER\b", r"(?i)\bFI\s*\|\s*RE\b", r"(?i)\bHAR\s*\|\s*DWARE\b"]
ROW_WORDS = ["EXISTING", "NEW", "HM", "WD", "ALUM", "FRAME", "LOCK", "HINGE", "CLOSER", "PAIR", "PR ", "GL-", "HDWR", "HARDWARE"]

# Cells of schedule tables.
TABLE_DIMENSION = "\\d+\\s*['’]\\s*-\\s*\\d+(?:\\s+\\d+/\\d+)?\\s*\""
MARK_CELL = r"^([A-Za-z]{0,3}\d{2,4}[A-Za-z]?)(?:\s+(\d{1,2}))?$"
MARK_LEAD = r"^([A-Za-z]{0,3}\d{2,4}[A-Za-z]?)(?:\b|\s)(.*)$"
TABLE_SOURCES = ["pdfplumber_tables", "pdfplumber_rows"]
TABLE_SHAPES = ["compact", "formal", "opening_list", "packed_dimension"]
SET_COLUMNS = ["HDW SET", "HDWR SET", "HDWE SET", "HARDWARE SET"]
EXISTING_SET = ["E", "EXIST", "EXISTING", "EXISTING TO REMAIN"]
STATUS_WORDS = ["NEW", "EXISTING", "EXIST", "EXISTING TO REMAIN"]
COMPONENT_ROWS = ["HINGE", "LOCK", "CLOSER", "KICKPLATE", "KICK PLATE", "SWEEP", "THRESHOLD", "SILENCER"]
TABLE_WORDS = ["DOOR", "DOORS", "FRAME", "TYPE", "TYPES", "NOTES", "SCHEDULE", "WIDTH", "HEIGHT", "HARDWARE", "DETAIL", "COMMENTS", "MATERIAL"]
BAD_ROOMS = ["ELECTRICAL COMPONENTS", "PARTITION GENERAL NOTES", "DOOR GENERAL NOTES"]

# Fields of door and component rows, those that extra fields may fill, and headings that are no row.
DOOR_FIELDS = [
    "door_number", "level_area", "room_name", "door_type", "frame_type", "frame_width", "frame_height", "door_width", "door_height", "hardware_set", "fire_rating", "head_jamb_sill_detail",
    "keyed_notes", "remarks", "door_slab_material", "vision_panel", "glazing_type", "finish", "door_thickness", "door_material", "door_finish", "frame_material", "frame_finish", "elevation",
]
PROMOTED = [
    "door_thickness", "door_material", "door_finish", "frame_material", "frame_finish", "elevation", "door_type", "room_name", "fire_rating", "hardware_set", "door_width", "door_height",
    "frame_type", "finish", "remarks",
]
DOOR_HEADINGS = ["DOOR", "MARK", "NO", "NUMBER", "DOOR NUMBER", "DOOR NO"]
COMPONENT_FIELDS = ["hardware_set_id", "hardware_set_name", "qty", "qty_raw", "unit", "description", "catalog_number", "finish_code", "manufacturer_code", "notes"]
COMPONENT_HEADINGS = ["DESCRIPTION", "COMPONENT", "ITEM"]

# Hardware layouts of page texts.
VENDOR_COMPONENTS = [
    "HINGE", "EXIT", "EXIT DEVICE", "CYLINDER", "CORE", "PULL", "CLOSER", "CONTINUOUS HINGE", "KICK PLATE", "ARMOR PLATE", "MOP PLATE", "PUSH PLATE", "THRESHOLD", "WEATHERSTRIP", "SEAL",
    "GASKET", "DOOR BOTTOM", "ASTRAGAL", "GASKETING", "SWEEP", "RAIN GUARD", "LOCKSET", "LEVERSET", "DEADLOCK", "DEADBOLT", "FLUSH BOLT", "FLUSH PULL", "HEADER BOLT", "THRESHOLD BOLT",
    "OVERHEAD HOLDER", "SILENCER", "STRIKE", "DUST PROOF STRIKE", "ELECTRIC STRIKE", "POWER TRANSFER", "HARNESS", "CARD READER", "POWER SUPPLY", "POINT-TO-POINT", "ELEVATION DIAGRAM",
    "RISER DIAGRAM", "COORDINATOR", "WALL BUMPER", "FLOOR STOP", "DOOR STOP", "LATCH PROTECTOR", "HOLDER", "VIEWER", "STOP",
]
STRONG_COMPONENTS = [
    "HINGE", "EXIT", "CLOSER", "LOCK", "DEAD", "STRIKE", "THRESHOLD", "WEATHER", "SEAL", "GASKET", "SWEEP", "STOP", "PULL", "BOLT", "HARNESS", "READER", "POWER", "SILENCER", "PLATE",
]
# Two more, which the side-by-side layout needs: its sample sheet counts locks and panic hardware as components.
CELL_COMPONENTS = [*VENDOR_COMPONENTS, "LOCK", "PANIC"]
VENDOR_MAKERS = ["CKN", "FL", "GL", "HA", "LO", "NO", "PE", "SC", "TR", "IVE", "LCN", "NGP", "SCH", "VON"]
VENDOR_PAGE = r"(?i)\bSET\s*#?\s*[A-Z0-9.-]+\b"
VENDOR_HEADER = r"(?i)^\s*SET\s*#?\s*([A-Z0-9.-]+)\s*(?:[-:]\s*(.+))?$"
VENDOR_COMPONENT = r"(?i)^\s*\(?(\d+(?:-\d+/\d+)?|LOT)\)?\s+(?:(EA|EACH|SET|PR|PAIR)\s+)?(.+?)\s*$"
HARDWARE_TITLE = r"(?i)\b(?:DOOR\s+HARDWARE\s+SCHEDULE|HARDWARE\s+SETS?|HARDWARE\s+GROUPS?)\b"
GRID_PAGE = r"(?i)\b(?:HARDWARE\s+SCHEDULE|SET\s*:\s*[A-Z0-9.]+)\b"
GRID_SET = r"(?i)\bSET\s*:\s*[A-Z0-9.]+\b"
GRID_HEADER = r"(?i)\bSET\s*[:#]?\s*([A-Z0-9.]+)\b"
GRID_COMPONENT = r"(?i)^(\d+(?:-\d+/\d+)?)\s*(?:(EA|EACH|SET|PR|PAIR)\.?)?\s+(.+?)$"
GROUP_HEADER = r"(?i)\bHARDWARE\s+GROUP\s+NO\.?\s*([A-Z0-9.]+)\b"

# Words and patterns of the page classifier and of the content score.
SIGNAL_ROW_WORDS = ["EXISTING", "NEW", "HM", "WD", "AL", "FRAME", "LOCK", "HINGE", "GL-"]
SIGNAL_HEADERS = [
    "DOOR SCHEDULE", "DOOR NO", "DOOR NUMBER", "ROOM NAME", "WIDTH", "HEIGHT", "FRAME", "HARDWARE", "HDWR", "HDWE", "HDW", "FIRE RATING", "COMMENTS", "DOOR TYPE", "ROOM NAME", "RM NAME", "DR #",
    "OPENING SCHEDULE",
]
SIGNAL_HARDWARE = ["HINGE", "BUTT", "PIVOT", "CLOSER", "LOCK", "LATCH", "DEADBOLT", "THRESHOLD", "WEATHERSTRIP", "DOOR STOP", "KICK PLATE", "EXIT DEVICE", "FLUSH BOLT"]
SIGNAL_TITLES = [
    "PROJECT LOCATION", "OWNER", "REVISIONS", "DRAWN BY", "CHECKED BY", "SHEET", "PHONE:", "WWW.", "ARCHITECTS", "SUITE", "STREET", "CITY", "ZIP", "FIRST ISSUED ON",
]
SCORED_HARDWARE = r"(?i)\b(?:HINGE|CLOSER|LOCK|STOP|THRESHOLD|SEAL)\b"
SCHEDULE_TERMS = ["DOOR", "HARDWARE", "HDWR", "HDWE", "HW", "FRAME", "OPENING", "SCHED"]
SET_BLOCKS = r"(?m)^\s*(?:HARDWARE\s+SETS?|SET\s*#?\s*\d+|SET\s+NO\.?|GROUP\s*#?\s*\d+)"
SET_DESCRIPTIONS = r"\bHARDWARE\s+SET\s+DESCRIPTIONS?\b"
PAGE_PARTS = r"\b(?:HINGE|CLOSER|LOCKSET|EXIT\s+DEVICE|CYLINDER|THRESHOLD|KICK\s+PLATE|SMOKE\s+SEAL|DOOR\s+BOTTOM|ASTRAGAL|WALL\s+BUMPER)\b"
LATER_PARTS = r"(?:BUTT HINGE|SURFACE CLOSER|FLOOR STOP|WALL STOP|LOCKSET|DEADBOLT|KICK PLATE|THRESHOLD|DOOR STOP)"
LATER_SETS = (
    r"(?m)^\s*(?:HARDWARE\s+SET|HARDWARE\s+GROUP|HDWE\s+SET|HDWR\s+SET|HW\s+SET|SET\s*NO\.?|GROUP\s*NO\.?|HW\s*[#\-]?\s*\d+|SET\s*[#\-]?\s*\d+|GROUP\s*[#\-]?\s*\d+)"
)
SPEC_PROSE = [
    "PART 1", "PART 2", "PART 3", "SUBMITTALS", "QUALITY ASSURANCE", "PRODUCT DATA", "SHOP DRAWINGS", "WARRANTY", "TEMPLATES", "KEYING", "INSTALLATION", "ADJUSTING", "CLEANING AND PROTECTION",
    "OPERATION AND MAINTENANCE", "MAINTENANCE DATA", "CLOSEOUT",
]
BACKSTOP_WORDS = ["DOOR SCHEDULE", "DOOR NO", "DOOR NUMBER", "DOOR MARK", "HARDWARE SET", "HW SET", "HDWR SET", "FRAME TYPE", "FIRE RATING", "DOOR TYPE"]
BACKSTOP_PARTS = ["HINGE", "CLOSER", "LOCKSET", "DEADBOLT", "THRESHOLD", "DOOR STOP", "KICK PLATE"]
NATIVE_WORDS = [
    "door", "frame", "schedule", "hardware", "width", "height", "thickness", "type", "material", "finish", "opening", "closer", "lock", "latch", "hinge", "set", "mark", "room",
]
NATIVE_DOORS = r"(?i)\bdoor\s+schedule\b|\bopening\s+(?:no|number|mark)\b|\bdoor\s+(?:no|number|mark)\b"
NATIVE_HARDWARE = r"(?i)\bhardware\s+(?:set|sets|group|groups)\b|\bhw\s+set\b|\bhw\s+group\b|\bhardware\s+specification\b"

# Set ids in raw text.
TRUTH_SETS = [r"(?:set|SET|Set)\s*[#:.\-]?\s*(\d+[A-Za-z]?)", r"(?:HW|hw|Hw)\s*[#:.\-]?\s*(\d+[A-Za-z]?)", r"(?:Hardware Set|HARDWARE SET)\s*(?:No\.?\s*)?(\d+[A-Za-z]?)"]

# Crop and door rows of the backend.
CROP_SET = r"\b(?:SET|HW\s*SET|HARDWARE\s*SET)\s*#?\s*[A-Z]?\d+[A-Z]?\b"
CROP_PARTS = r"\b(EXIT\s+DEVICE|CONTINUOUS\s+HINGE|HINGE|CLOSER|LOCKSET|LATCHSET|CYLINDER|THRESHOLD|WEATHERSTRIP|GASKET|SWEEP|PUSH\s+PLATE|PULL)\b"
CROP_DOORS = r"\bDOOR\s+NUMBER\b|\bTYPE\s+WIDTH\b|\bWINDOW\s+NOTES\b|\bWINDOW\s+TYPES\b"
NO_MARK = [
    "", "-", "--", "---", "----", "—", "N/A", "NA", "NONE", "NULL", "UNKNOWN", "NOT SHOWN", "NOT PROVIDED", "TBD", "?", "DOOR NUMBER", "DOOR NO", "DOOR NO.", "NO.", "MARK", "TAG", "OPENING", "#",
]
ROOM_MARKS = [
    "RESTROOM", "KITCHEN", "OFFICE", "BREAKRM", "BREAK ROOM", "STORAGE", "CORRIDOR", "HALL", "LOBBY", "VESTIBULE", "TOILET", "MECH", "MECHANICAL", "ELECTRICAL", "JANITOR", "CLOSET",
]
TYPE_LABEL = r"^(?:[A-Z]|[A-Z]{1,2}[-]?\d{1,2}[A-Z]?|HM|WD|FR|FG)$"
CLOSED_SET = ["voided", "not_used", "void"]

# Categories of a question, first match wins.
CATEGORIES = [
    (r"hardware set|hw set|missing.*set|no hardware", "Hardware mapping"),
    (r"electrified|access control|card reader|maglock|electric strike|eac|low.?voltage", "Access control / electrified"),
    (r"panic|exit device|egress", "Egress / panic hardware"),
    (r"fire.?rated|ul|smoke gasket|self.?closing|positive latching", "Fire / smoke rating"),
    (r"storefront|aluminum|curtain wall|exterior|threshold|weather", "Exterior / storefront"),
    (r"operator|automatic|ada|closer", "ADA / operator"),
    (r"finish", "Finish coordination"),
    (r"lead time|long.?lead|substitution|specialty", "Supply / lead-time"),
]
OTHER_CATEGORY = "General coordination"

# Openings that are not mapped to hardware, and access-control wording.
BY_OTHERS = ["BY OTHERS", "N.I.C.", "NIC"]
COILING = ["COILING", "ROLL-UP", "ROLL UP", "ROLLING", "SHUTTER", "OVERHEAD", "SECTIONAL", "ASTA", "QMI"]
ACCESS_WORDS = r"(?i)\bCR\b|\bEL\b|\bDPS\b|\bRX\b|\bEH\b|\bAO\b|panic|card reader|access control|electrified|maglock|electric\s*strike|EPT|REX|automatic\s*operator"

# Notes of the mapping's status rows.
STATUS_NOTES = {
    "BY_OTHERS": "(opening is by others / not in contract; not mapped)",
    "EXISTING_TO_REMAIN": "(existing door - hardware to remain; not mapped per rule)",
    "COILING_SYSTEM": "(coiling/overhead door - hardware supplied by door manufacturer; not mapped)",
    "NO_HW_SET": "(no hardware set assigned)",
    "EMPTY": "(hardware set has no extracted items)",
    "ABSENT": "(hardware set not found in spec)",
}

# Names that columns of schedules and answers have, grouped by the field that they mean: each group is used as one list.
FIELD_NAMES = {
    "door_number": ["number", "door_number", "door number", "door_no", "mark", "door mark", "door_mark", "id", "door_id", "door id"],
    "room_name": ["room name", "room_name", "location", "room"],
    "door_type": ["door type", "door_type", "type"],
    "frame_type": ["frame type", "frame_type", "frame"],
    "door_width": ["width", "door_width", "door width"],
    "door_height": ["height", "door_height", "door height"],
    "door_thickness": ["thickness", "door_thickness", "door thickness", "thk"],
    "door_material": ["material", "door_material", "door material", "dr matl"],
    "door_finish": ["finish", "door_finish", "door finish", "dr fin", "dr finish"],
    "frame_material": ["frame_material", "frame material", "fr matl"],
    "frame_finish": ["frame_finish", "frame finish", "fr fin", "fr finish"],
    "elevation": ["elevation", "elev", "door elev"],
    "hardware_set": ["hardware set", "hardware_set", "hw set", "hdwr set"],
    "fire_rating": ["fire rating", "fire_rating", "fire rate"],
    "remarks": ["comments", "remarks", "notes"],
    "door_slab_material": ["door_slab_material", "slab material"],
    "vision_panel": ["vision panel", "vision_panel"],
    "glazing_type": ["glazing", "glazing_type"],
    "level_area": ["level", "level_area", "area"],
    "is_pair": ["is_pair", "is pair"],
    "door_leaves": ["door_leaves", "leaves"],
    "frame_width": ["frame_width", "frame width"],
    "frame_height": ["frame_height", "frame height"],
    "head_jamb_sill_detail": ["head_jamb_sill_detail"],
    "keyed_notes": ["keyed_notes"],
    "hardware_set_id": ["hardware_set_id", "set", "set_id", "set id", "set no", "set no.", "group", "group no", "group no.", "hw", "hdwr", "hdwe"],
    "hardware_set_name": ["hardware_set_name", "function"],
    "qty": ["qty", "quantity"],
    "qty_raw": ["qty_raw", "quantity_raw", "quantity raw"],
    "unit": ["unit"],
    "description": ["description", "desc", "component"],
    "catalog_number": ["catalog_number", "catalog number", "catalog no", "catalog no.", "model"],
    "finish_code": ["finish_code", "finish code"],
    "manufacturer_code": ["manufacturer_code", "manufacturer", "mfr"],
}

# The browser's rules: severities as risk and as question ('' for none) and patterns of each family.
FAMILIES = {
    "Hardware mapping": ("high", "high"), "Hardware set definitions": ("high", "high"), "Voided hardware set": ("high", "high"), "Fire-rated openings": ("medium", ""), "Fire / smoke rating": ("", "medium"),
    "Stair enclosures": ("", "medium"), "Exterior / weather": ("medium", "medium"), "Access control / electrified": ("high", "high"), "ADA / automatic operators": ("medium", "medium"),
    "Egress / exit devices": ("medium", "medium"), "Pair / double-leaf openings": ("medium", "medium"), "High-security openings": ("medium", "medium"), "Keying / cylinders": ("medium", "medium"),
    "Acoustic / STC-rated": ("medium", "medium"), "Existing conditions": ("medium", "medium"), "Glazing / vision lites": ("", "low"), "Schedule legibility": ("low", ""), "Schedule completeness": ("", "low"),
    "Submittal / lead time": ("low", "low"),
}
POWER_BY_EC = [
    r"(?i)\b(EC|electrical contractor|division\s*26|div\.?\s*26)\b[^.]{0,80}\b(provide|supply|by)\b[^.]{0,40}\b(120\s*v|power|line\s*voltage)\b",
    r"(?i)\b120\s*v[^.]{0,40}\b(by|provided by)\b[^.]{0,30}\b(EC|electrical contractor)\b",
]
CABLING_BY_OTHERS = r"(?i)\b(low[-\s]?voltage|cabling|access\s*control|EAC|head[-\s]?end)\b[^.]{0,60}\b(by|provided by|N\.?I\.?C\.?|not in contract)\b"
KEYING_DEFINED = r"(?i)\b(master|grand\s*master|sub[-\s]?master|keyway|SFIC|LFIC|construction\s*core|restricted)\b"
LEGEND_ACCESS = r"(?i)reader|card|electric|maglock|magnetic|access|operator|REX|EPT|power\s*transfer|delayed\s*egress|panic|exit"
VOIDED_WORDS = r"(?i)void|cross|strike|withdrawn|deleted"
STAIR_WORDS = r"(?i)stair|exit stair|stairwell"
EXTERIOR_WORDS = r"(?i)exterior|exit\s*to\s*exterior|out\s*to\s*grade"
ELECTRIFIED_WORDS = (
    r"(?i)\bCR\b|\bEL\b|\bDPS\b|\bRX\b|\bEH\b|\bAO\b|panic|card reader|access control|electrified|magnetic\s*lock|maglock|electric\s*strike|electric\s*latch|automatic\s*operator|push\s*paddle|"
    r"power\s*supply|power\s*transfer|EPT|REX|request[-\s]to[-\s]exit|delayed\s*egress|stand[-\s]?alone\s*lock"
)
OPERATOR_WORDS = r"(?i)\bAO\b|automatic\s*operator|low\s*energy\s*operator|push\s*paddle|barrier[-\s]?free|accessible|ADA"
PANIC_WORDS = r"(?i)panic|exit\s*device|crash\s*bar|push\s*pad|cvr|surface\s*vertical\s*rod|mortise\s*exit|rim\s*exit"
PAIR_OPENINGS = r"(?i)pair|double|2[\s-]?leaf|astragal|coordinator|flush\s*bolt"
SECURITY_WORDS = (
    r"(?i)vault|safe\s*room|secure|secured\s*entry|bullet|ballistic|detention|holding|interview|interrogation|server|IDF|MDF|telecom|comm\s*room|electrical\s*closet"
)
ACOUSTIC_WORDS = r"(?i)STC|acoustic|sound\s*(?:seal|rated|attenuat)"
EXISTING_WORDS = r"(?i)existing|EX\b|re-?use|salvage|relocate|infill"

# Keys of an answer that is a row itself; words of tables that OCR reads.
ROW_KEYS = ["door_number", "number", "hardware_set_id", "set_id", "opening", "room", "door"]
HEADER_WORDS = {
    "number": ["NUMBER", "NO", "DOOR NO", "DOOR NUMBER", "MARK", "TAG", "OPENING", "#"], "room": ["ROOM", "ROOM NAME", "ROOMNAME"], "size": ["SIZE"], "type": ["TYPE"], "hardware": ["HARDWARE", "HDW", "HW"],
    "rating": ["RATING"], "remarks": ["REMARK", "REMARKS"],
}
OCR_HEADER = ["NUMBER", "ROOM", "SIZE", "TYPE", "HARDWARE", "SET", "RATING", "REMARKS"]
NUMBER_WORDS = ["NO.", "NO", "DOOR NO", "DOOR NO."]
OCR_EXCLUDED = {"door_type": ["TYPE"], "door_width": ["WIDTH"], "door_height": ["HEIGHT"], "door_thickness": ["THICKNESS", "THICKNESSTHICKNESS", "DOOR"], "hardware_set": ["HARDWARE", "SET"]}
OCR_NOISE = ["SCHEDULE", "ASSEMBLY", "LOCATION", "DIMENSIONS"]

# Forms of cells and codes.
MARK_TOKEN = r"^(?:\d{2,4}[A-Za-z]?|[A-Za-z]{1,3}\d{2,4}[A-Za-z]?)$"
NO_MARK_TOKEN = ["", "MARK", "DOOR", "NO", "NUMBER"]
SET_TOKEN = r"(?i)^(?:[A-Z]?\d{1,4}[A-Z]{0,3}(?:-[A-Z0-9]+)?|[A-Z]+-?\d{1,4}[A-Z0-9-]*|\d{1,2}\.\d)$"
FINISH_CODE = r"^(?:(?:US)?\d{3}[A-Z]{0,2}|(?:US)?\d{2}[A-Z]{1,2}|(?:US)?[A-Z]{2}\d{2,4}[A-Z]?)$"
INCHES_WHOLE = r'^(\d+)(?:\s+\d+/\d+)?\s*"?$'
INCHES_DECIMAL = r'^(\d+\.\d+)\s*"?$'
INCHES_FRACTION = r'^\d+\s+(\d+)/(\d+)\s*"?$'

# Signals that a page's reading must not lose, the marker between pages, cells and optical rows.
DOOR_SIGNAL = r"(?i)\bdoor\s+schedule\b|\bopening\s+(?:no|number|mark)\b|\bdoor\s+(?:no|number|mark)\b"
HARDWARE_SIGNAL = r"(?i)\bhardware\s+(?:set|sets|group|groups)\b|\bhw\s+set\b|\bhw\s+group\b|\bhardware\s+specification\b"
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
CELL_LENGTH, ROW_HEIGHT, LEAST_CONFIDENCE = 80, 15, 0.3

# Tokens of a model's context and of an answer by the model's name, the first that fits; what an image and the reserve take.
CONTEXT_TOKENS = [("^(gpt-4o|gpt-4[.]1|gpt-5|o1|o3)", 128000), ("llama-3[.]3|70b", 128000), ("qwen3", 32768), ("qwen2[.]5", 32768), ("llama3[.]1", 128000)]
OUTPUT_TOKENS = [("^(gpt-4o|gpt-4[.]1|gpt-5|o1|o3)", 12000), ("qwen3-vl", 4096), ("qwen|llama|mistral", 6144)]
USUAL_CONTEXT, USUAL_OUTPUT, IMAGE_TOKENS, RESERVED_TOKENS, LEAST_TOKENS = 8192, 4096, 1200, 768, 512
