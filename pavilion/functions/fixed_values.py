"""Fixed values that results depend on: word lists, lookup tables, patterns.

They are data, not logic, and are listed in their natural order. Where two names share
a code the first one listed is the display name.
"""

# --- team name or code -> team code -------------------------------------------------
TEAM_CODES = {
    # full members
    "India": "IND", "Australia": "AUS", "England": "ENG",
    "Pakistan": "PAK", "South Africa": "SA", "New Zealand": "NZ",
    "Sri Lanka": "SL", "West Indies": "WI", "Bangladesh": "BAN",
    "Afghanistan": "AFG", "Ireland": "IRE", "Zimbabwe": "ZIM",
    # associates and affiliates
    "Netherlands": "NED", "Scotland": "SCO", "Kenya": "KEN",
    "Canada": "CAN", "United Arab Emirates": "UAE", "U.A.E.": "UAE",
    "Oman": "OMA", "Nepal": "NEP", "Namibia": "NAM",
    "United States of America": "USA", "U.S.A.": "USA",
    "Papua New Guinea": "PNG", "P.N.G.": "PNG",
    "Hong Kong": "HK", "Bermuda": "BER", "Uganda": "UGA",
    "Jersey": "JER", "Guernsey": "GUE", "Germany": "GER",
    "Italy": "ITA", "Denmark": "DEN", "Singapore": "SIN",
    "Malaysia": "MAL", "Thailand": "THA", "Myanmar": "MYA",
    "Tanzania": "TAN", "Vanuatu": "VAN", "Fiji": "FIJ",
    "Cayman Islands": "CAY", "Kuwait": "KUW", "Saudi Arabia": "SAU",
    "Qatar": "QAT", "Bahrain": "BHR", "Botswana": "BOT",
    "Malawi": "MAW", "Mozambique": "MOZ", "Nigeria": "NGA",
    "Ghana": "GHA", "Cameroon": "CMR", "Sierra Leone": "SLE",
    "Rwanda": "RWA", "Lesotho": "LES", "Swaziland": "SWZ",
    "Eswatini": "SWZ", "Zambia": "ZAM",
    "Argentina": "ARG", "Brazil": "BRA", "Chile": "CHL",
    "Mexico": "MEX", "Panama": "PAN", "Belize": "BLZ",
    "Costa Rica": "CRC", "Suriname": "SUR",
    "Austria": "AUT", "Belgium": "BEL", "Croatia": "CRO",
    "Czech Republic": "CZE", "Czechia": "CZE",
    "Estonia": "EST", "Finland": "FIN", "France": "FRA",
    "Gibraltar": "GIB", "Greece": "GRE", "Hungary": "HUN",
    "Isle of Man": "IOM", "Israel": "ISR", "Luxembourg": "LUX",
    "Malta": "MLT", "Norway": "NOR", "Portugal": "POR",
    "Romania": "ROM", "Russia": "RUS", "Serbia": "SRB",
    "Slovenia": "SVN", "Spain": "ESP", "Sweden": "SWE",
    "Switzerland": "SUI", "Turkey": "TUR",
    "Iran": "IRN", "Iraq": "IRQ", "Japan": "JPN",
    "South Korea": "KOR", "China": "CHN", "Taiwan": "TPE",
    "Philippines": "PHI", "Indonesia": "INA",
    "Maldives": "MDV", "Bhutan": "BHU",
    "Samoa": "SAM", "Tonga": "TGA", "Cook Islands": "COK",
    # Caribbean sides
    "Trinidad & Tobago": "TT", "Trinidad and Tobago": "TT",
    "Jamaica": "JAM", "Barbados": "BAR", "Guyana": "GUY",
    "Leeward Islands": "LEE", "Windward Islands": "WIN",
    "Bahamas": "BAH", "St Lucia": "STL", "St Vincent": "STV",
    "Antigua and Barbuda": "ANT", "Turks and Caicos": "TCI",
    # invitation and former sides
    "ICC World XI": "WXI", "World XI": "WXI",
    "Asia XI": "AXI", "Africa XI": "AFX",
    "East Africa": "EAF", "Marylebone Cricket Club": "MCC",
    # codes that stand for themselves
    "IND": "IND", "AUS": "AUS", "ENG": "ENG", "PAK": "PAK",
    "SA": "SA", "NZ": "NZ", "SL": "SL", "WI": "WI",
    "BAN": "BAN", "AFG": "AFG", "IRE": "IRE", "ZIM": "ZIM",
    "NED": "NED", "SCO": "SCO", "KEN": "KEN", "CAN": "CAN",
    "UAE": "UAE", "OMA": "OMA", "NEP": "NEP", "NAM": "NAM",
    "USA": "USA", "PNG": "PNG", "HK": "HK", "BER": "BER",
    "UGA": "UGA", "JER": "JER", "GER": "GER", "ITA": "ITA",
}

# --- short code -> full team name, as used in the match registry -----------------------
REGISTRY_TEAMS = {
    "IND": "India", "AUS": "Australia", "ENG": "England", "SA": "South Africa",
    "PAK": "Pakistan", "NZ": "New Zealand", "SL": "Sri Lanka", "WI": "West Indies",
    "BAN": "Bangladesh", "AFG": "Afghanistan",
}

# --- sources a registered match can be linked to ----------------------------------------
REGISTRY_SOURCES = ("ca", "cricbuzz", "espn")

# --- team code -> home advantage ---------------------------------------------------------
HOME_ADVANTAGE = {
    "IND": 0.12, "AUS": 0.10, "ENG": 0.09, "PAK": 0.08,
    "SA": 0.09, "NZ": 0.08, "SL": 0.10, "WI": 0.07,
    "BAN": 0.09, "AFG": 0.06, "IRE": 0.06, "ZIM": 0.06,
    "NED": 0.04, "SCO": 0.04, "USA": 0.04, "NAM": 0.04,
    "OMA": 0.04, "NEP": 0.04, "PNG": 0.03, "KEN": 0.04,
    "CAN": 0.03, "UAE": 0.04, "HK": 0.03, "BER": 0.03,
}
DEFAULT_HOME_ADVANTAGE = 0.03

# --- known wicketkeepers by team ---------------------------------------------------------
WICKETKEEPERS = {
    "IND": ["KL Rahul", "Rishabh Pant", "Sanju Samson", "Ishan Kishan",
            "Dhruv Jurel", "MS Dhoni", "Wriddhiman Saha", "Dinesh Karthik"],
    "AUS": ["Alex Carey", "Josh Inglis", "Josh Philippe", "Tim Paine",
            "Matthew Wade", "Brad Haddin", "Adam Gilchrist"],
    "ENG": ["Jos Buttler", "Jonny Bairstow", "Ben Foakes", "Jamie Smith",
            "Phil Salt", "Sam Billings", "Matt Prior"],
    "PAK": ["Mohammad Rizwan", "Sarfaraz Ahmed", "Kamran Akmal", "Azam Khan"],
    "SA": ["Quinton de Kock", "Heinrich Klaasen", "Kyle Verreynne",
           "AB de Villiers", "Mark Boucher"],
    "NZ": ["Tom Latham", "Tom Blundell", "Devon Conway", "BJ Watling",
           "Luke Ronchi", "Brendon McCullum"],
    "SL": ["Kusal Mendis", "Niroshan Dickwella", "Kusal Perera",
           "Dinesh Chandimal", "Kumar Sangakkara"],
    "WI": ["Shai Hope", "Joshua Da Silva", "Nicholas Pooran",
           "Denesh Ramdin", "Shane Dowrich"],
    "BAN": ["Mushfiqur Rahim", "Litton Das", "Nurul Hasan"],
    "AFG": ["Rahmanullah Gurbaz", "Ikram Alikhil", "Mohammad Shahzad"],
    "IRE": ["Lorcan Tucker", "Neil Rock", "Gary Wilson"],
    "ZIM": ["Regis Chakabva", "Clive Madande", "Brendan Taylor", "Tatenda Taibu"],
    "NED": ["Scott Edwards", "Wesley Barresi"],
    "SCO": ["Matthew Cross"],
    "NAM": ["Zane Green"],
    "USA": ["Monank Patel", "Andries Gous"],
    "OMA": ["Naseem Khushi", "Pratik Athavale"],
    "NEP": ["Aasif Sheikh"],
    "PNG": ["Kiplin Doriga", "Hiri Hiri"],
    "KEN": ["Morris Ouma", "Collins Obuya"],
    "CAN": ["Hamza Tariq"],
    "HK": ["Aizaz Khan"],
}

# --- known captains by team --------------------------------------------------------------
CAPTAINS = {
    "IND": ["Rohit Sharma", "Suryakumar Yadav", "Jasprit Bumrah"],
    "AUS": ["Pat Cummins", "Mitchell Marsh", "Steve Smith"],
    "ENG": ["Ben Stokes", "Jos Buttler", "Joe Root"],
    "PAK": ["Shan Masood", "Babar Azam", "Mohammad Rizwan"],
    "SA": ["Temba Bavuma", "Aiden Markram"],
    "NZ": ["Tom Latham", "Mitchell Santner", "Kane Williamson"],
    "SL": ["Dhananjaya de Silva", "Charith Asalanka"],
    "WI": ["Kraigg Brathwaite", "Rovman Powell", "Shai Hope"],
    "BAN": ["Najmul Hossain Shanto"],
    "AFG": ["Hashmatullah Shahidi", "Rashid Khan", "Ibrahim Zadran"],
    "IRE": ["Andrew Balbirnie", "Paul Stirling"],
    "ZIM": ["Craig Ervine", "Sikandar Raza"],
    "NED": ["Scott Edwards"],
    "SCO": ["Richie Berrington"],
    "NAM": ["Gerhard Erasmus"],
    "USA": ["Monank Patel"],
    "OMA": ["Aqib Ilyas"],
    "NEP": ["Rohit Paudel"],
}

# --- match formats and player roles accepted by the domain checks -------------------------
MATCH_FORMATS = ("Test", "ODI", "T20")
PLAYER_ROLES = ("Batsman", "Bowler", "Allrounder", "Wicketkeeper")

# --- player and team defaults -------------------------------------------------------------
PLAYER_DEFAULTS = {
    "batting_avg": 0.0, "batting_sr": 0.0, "bowling_avg": 99.0, "bowling_sr": 0.0,
    "economy": 5.0, "recent_form": 0.5, "experience": 0,
    "is_captain": False, "is_wicketkeeper": False,
}

# --- entity links: kind -> patterns tried in this order -----------------------------------
ENTITY_URL_PATTERNS = {
    "player": [r"/Players/\d+/\d+/(\d+)\.html", r"/Players/\d+/(\d+)\.html"],
    "team": [r"/Teams/\d+/\d+/(\d+)\.html", r"/Teams/\d+/(\d+)\.html"],
    "tournament": [r"/Events/(\d+)/", r"/Events/([^/]+)\.html"],
    "ground": [r"/Grounds/\d+/(\d+)\.html"],
}

# --- words that decide the format of a match ----------------------------------------------
VENUE_FORMATS = [
    ("T20", ["20-over", "Twenty20"]),
    ("List A", ["50-over", "45-over", "40-over", "One-Day"]),
    ("First-Class", ["three-day", "four-day", "five-day", "First-Class", "Test"]),
]
TOURNAMENT_FORMATS = [
    ("T20", ["T20", "Twenty20"]),
    ("List A", ["ODI", "One-Day", "One Day", "List A", "List-A"]),
    ("First-Class", ["Test", "First-Class", "Ranji", "County", "Shield"]),
]
EVENT_FORMATS = [
    ("Test", ["test"]),
    ("T20", ["t20", "twenty20"]),
    ("ODI", ["odi", "one day"]),
    ("T20", ["ipl", "bbl", "cpl"]),
]

# --- page and log texts --------------------------------------------------------------------
GENERIC_PAGE_TITLE = "The Home of CricketArchive"
LIVE_TITLE_MARK = "Live Cricket Score"
NOTE_MARK = "-->"
BALL_BY_BALL_PREFIX = "cricsheet_"
ARCHIVE_PREFIX = "ca_"

# --- leaderboard headers: output column -> accepted headers, first match wins ---------------
BATTING_HEADERS = {
    "country": ["Country", "Team"], "span": ["Span"], "matches": ["Mat", "Matches"],
    "innings": ["Inns"], "not_outs": ["NO"], "runs": ["Runs"], "highest": ["HS"],
    "batting_avg": ["Ave", "Avg"], "balls_faced": ["BF", "Balls"], "batting_sr": ["SR"],
    "hundreds": ["100", "100s"], "fifties": ["50", "50s"],
    "fours": ["4s", "fours"], "sixes": ["6s", "sixes"],
}
BOWLING_HEADERS = {
    "country": ["Country", "Team"], "span": ["Span"], "matches": ["Mat"],
    "innings": ["Inns"], "overs": ["Overs", "Balls"], "maidens": ["Mdns"],
    "runs_conceded": ["Runs"], "wickets": ["Wkts"], "bbi": ["BBI"],
    "bowling_avg": ["Ave", "Avg"], "economy": ["Econ"], "bowling_sr": ["SR"],
    "five_wickets": ["5", "5w", "5Wi"], "ten_wickets": ["10", "10w"],
}
TABLE_MARKERS = {
    "batting": ["mat", "inns", "runs", "ave"],
    "bowling": ["mat", "inns", "wkts", "ave"],
}
SUMMARY_LABELS = ["nan", "overall", "total", ""]

# --- patterns of fixed texts, in the order in which pages are read ----------------------------------
VENUE_DATE = r"on\s+([0-9a-zA-Z\s,]+)(?:\s+\(|\s*$)"
ORDINAL_DATE = r"on (\d+(?:st|nd|rd|th)? [A-Za-z]+ \d{4})"
SEASON_YEAR = r"(?U)\b(?:17|18|19|20)\d{2}\b"
WON_BY_RUNS = r"won by (\d+) run"
WON_BY_WICKETS = r"won by (\d+) wicket"
EXTRAS_PART = r"(\d+)\s+{unit}"
TOTAL_WICKETS = r"(\d+)\s+wicket"
TOTAL_OVERS = r"(\d+\.?\d*)\s+over"
FALLEN_WICKET = r"^(\d+)-(\d+)"
FALLEN_OVERS = r"(\d+\.?\d*)\s+ov"
ORDINAL_SUFFIX = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b"
#: Forms that dates are written in, tried in this order.
DATE_FORMS = ["yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "d/M/yyyy", "yyyy/MM/dd", "yyyyMMdd"]
DATE_OF_BIRTH = r"dob:\s*([^']+)"
PLAYER_LABEL = r"^(.+?)\s*\(([^)]+)\)\s*$"

#: The script element that embeds a page's data, whatever its other attributes and their order.
EMBEDDED_DATA = r"""(?s)<script\b(?=[^>]*\sid\s*=\s*["']?__NEXT_DATA__["'\s>])[^>]*>(.+?)</script>"""
