"""Word lists, code lists and spellings that results depend on."""

# ---- words that make or unmake a teacher, by source

TEACH_WORDS = ["teach", "tchr"]
NOT_TEACH_WORDS = ["sub", "assistant", "aide"]

GA_TEACH_WORDS = ["teach", "tch", "grade"]
GA_NOT_TEACH_WORDS = ["sub", "dispatcher", "graduate teaching assistant"]

IN_TEACH_WORDS = ["teach", "tch", "grade"]
IN_NOT_TEACH_WORDS = ["sub", "assis", "aid"]
IN_TEACH_POSITIONS = [
    "kindergarten", "special education", "elementary", "social studies", "language arts",
    "mathematics", "special ed", "grade 1", "grade 2", "grade 3", "grade 4", "grade 5",
    "1st grade", "2nd grade", "3rd grade", "4th grade", "5th grade",
]

KS_TEACH_WORDS = ["TEACHER", "TCH"]
KS_NOT_TEACH_WORDS = ["AIDE", "SUB", "ASSISTANT", "KITCHEN", "RETIRED"]
KS_TEACH_POSITIONS = [
    "English", "Science", "Mathematics", "Social Studies", "Kindergarten-All Day",
    "First Grade", "Second Grade", "Third Grade", "Fourth Grade", "Fifth Grade",
    "ESOL", "Math", "Instructor", "Interrelated-Sr High", "Art", "Interrelated-Middle",
    "Vocal Music Elem", "Physical Ed - Elem", "Physical Education", "Physical Ed",
    "Social Science", "Certified Instructor", "Art-Elementary", "Kindergarten",
    "Grade 1", "Grade 2", "Grade 3", "Grade 4", "Grade 5", "Grade 6", "Grade 7", "Grade 8",
]

IL_TEACH_POSITIONS = [
    "Elementary Teacher", "High School Teacher", "Junior High/Middle Teacher",
    "Kindergarten", "Special Education Teacher",
]
NY_TEACH_AGENCY = "NYSTRS - Educator"
ND_TEACH_POSITION = "Teacher"
OH_TEACH_POSITIONS = ["teacher assignment", "teacher", "regular teaching", "special education teaching"]
OK_TEACH_POSITIONS = ["TEACHER", "RESOURCE TEACHER"]
OK_PSEUDO_POSITIONS = ["TOTAL OTHER PAY", "TOTAL EXTRA DUTY PAY"]
PA_TEACH_POSITIONS = [
    "Elementary", "Elementary Special Ed. Teacher", "Elementary Teacher",
    "Secondary", "Secondary Special Ed. Teacher", "Secondary Teacher", "Special Education",
    "Specialized, K-12 OR Middle School", "Speech Correctionist", "Ungraded Special Ed. Teacher",
    "Ungraded Teacher",
]
WI_TEACH_CODE = "53"

# ---- codes

GENDER_CODES = {"F": ["F", "Female"], "M": ["M", "Male"]}
IL_RACE_CODES = {
    "AiAn": ["American Indian or Alaska Native", "American Indian or Alaskan Native"],
    "Asian": ["Asian", "Asian or Pacific Islander", "Native Hawaiian or Other Pacific Islander"],
    "Black": ["Black or African American", "Black, Non-Hispanic"],
    "Hispanic": ["Hispanic", "Hispanic or Latino"],
    "Unknown": ["NULL", "Unknow", "Unknown"],
    "Multi": ["Two or More Races"],
    "White": ["White", "White, Non-Hispanic"],
}
IL_NOT_RETIRED = ["No", "0"]
WI_RACE_CODES = {
    "Asian": ["A", "A - Asian"],
    "Black": ["B", "B - Black or African American"],
    "Hispanic": ["H", "H - Hispanic/Latino"],
    "AmericanIndian_AlaskaNative": ["I", "I - American Indian or Alaska Native"],
    "NativeHawiaan_PacificIslander": ["P", "P - Native Hawaiin or Other Pacific Islander"],
    "TwoOrMore": ["T", "Two or More Races"],
    "White": ["W", "W - White"],
}
WI_DEGREE_CODES = {
    "HighSchoolDiploma": ["2"],
    "Associate": ["3"],
    "Bachelor": ["4"],
    "Masters": ["5"],
    "6Year": ["6"],
    "Doctorate": ["7"],
    "Other": ["8"],
}
WI_CHANGED_POSITION_CODES = ["88", "92"]
#: Lengths that the layouts of a (two-digit year, start) give wrongly: a quote leads the line; a filler is shorter.
WI_CORRECTED_LENGTHS = {(12, 1): 10, (4, 132): 14}
NY_BAD_YEARS = [2008, 2009]

# ---- spellings of district names

CA_NAME_ENDINGS = [
    ("CITY SCHOOL DISTRICT", "CITY"),
    ("UNION SCHOOL DISTRICT", "UNION"),
    ("UNIFIED SCHOOL DISTRICT", "UNIFIED"),
]
CA_DISTRICT_NAMES = {
    "ACKERMAN CHARTER SCHOOL DISTRICT": "ACKERMAN CHARTER",
    "ALBANY UNIFIED": "ALBANY CITY UNIFIED",
    "AROMAS-SAN JUAN UNIFIED": "AROMAS/SAN JUAN UNF",
    "BERRYESSA UNION": "BERRYESSA UNION ELEM",
    "BONSALL UNION": "BONSALL UNIFIED",
    "BRAWLEY ELEMENTARY SCHOOL DISTRICT": "BRAWLEY ELEMENTARY",
    "BUCKEYE UNION": "BUCKEYE UNION ELEM",
    "CAMBRIAN SCHOOL DISTRICT": "CAMBRIAN",
    "CAMINO UNION": "CAMINO UNION ELEM",
    "COLUMBIA UNION ELEMENTARY": "COLUMBIA ELEMENTARY",
    "DEL NORTE COUNTY UNIFIED SCHOOLS": "DEL NORTE COUNTY UNIFIED",
    "EASTSIDE UNION": "EASTSIDE UNION ELEM",
    "EL DORADO UNION HIGH SCHOOL DISTRICT": "EL DORADO UNION HIGH",
    "FRUITVALE SCHOOL DISTRICT": "FRUITVALE ELEM",
    "GOLD TRAIL UNION": "GOLD TRAIL UNION ELEM",
    "HARMONY UNION": "HARMONY UNION ELEM",
    "HAWTHORNE SCHOOL DISTRICT": "HAWTHORNE",
    "HOLLISTER ELEMENTARY": "HOLLISTER",
    "IGO-ONO-PLATINA UNION ELEMENTARY": "IGO ONO PLATINA UNION ELEMENTARY",
    "INDIAN DIGGINGS SCHOOL DISTRICT": "INDIAN DIGGINS ELEM",
    "JUNCTION ELEMENTARY": "JUNCTION CITY ELEMENTARY",
    "KENWOOD SCHOOL DISTRICT": "KENWOOD",
    "KERN COUNTY SUPERINTENDENT OF SCHOOLS": "KERN COUNTY OFFICE OF EDUCATION",
    "KEYES UNION SCHOOL": "KEYES UNION",
    "KINGS CANYON UNIFIED": "KINGS CANYON JOINT UNF",
    "LAKESIDE UNION ELEMENTARY": "LAKESIDE UNION",
    "LANCASTER SCHOOL DISTRICT": "LANCASTER ELEMENTARY",
    "LEMON GROVE SCHOOL DISTRICT": "LEMON GROVE",
    "LENNOX SCHOOL DISTRICT": "LENNOX",
    "LOS ALTOS ELEMENTARY SCHOOL DISTRICT": "LOS ALTOS ELEM",
    "MARIN PUPIL TRANSPORTATION AUTHORITY": "MARIN PUPIL TRANSPORTATION AGENCY JPA",
    "MIDWAY SCHOOL DISTRICT": "MIDWAY ELEM",
    "MOTHER LODE UNION": "MOTHER LODE UNION ELEM",
    "MOUNTAIN VIEW-LOS ALTOS UNION HIGH SCHOOL DISTRICT": "MOUNTAIN VIEW-LOS ALTOS UNION HIGH",
    "NEVADA COUNTY SUPERINTENDENT OF SCHOOLS": "NEVADA COUNTY OFFICE OF EDUCATION",
    "NICASIO SCHOOL DISTRICT": "NICASIO",
    "NORTH COUNTY JOINT UNION": "NORTH COUNTY JOINT UNION ELEM",
    "NORTH COUNTY REGIONAL OCCUPATIONAL PROGRAM JOINT POWERS AGENCY":
        "NORTH COUNTY REGIONAL OCCUPATIONAL PROGRAM JOINT POWERS AGEN",
    "OAK GROVE SCHOOL DISTRICT": "OAK GROVE ELEM",
    "ORANGE CENTER ELEMENTARY": "ORANGE CENTER",
    "OXNARD SCHOOL DISTRICT": "OXNARD",
    "PACIFICA SCHOOL DISTRICT": "PACIFICA",
    "PETALUMA CITY SCHOOLS": "PETALUMA CITY ELEMENTARY/JOINT UNION",
    "PINER-OLIVET UNION": "PINER-OLIVET UNION ELEM",
    "PLACERVILLE UNION ELEMENTARY SCHOOL DISTRICT": "PLACERVILLE UNION ELEM",
    "PLEASANT VALLEY SCHOOL DISTRICT": "PLEASANT VALLEY",
    "POINT ARENA SCHOOLS DISTRICT": "POINT ARENA JOINT UNION HIGH",
    "POLLOCK PINES SCHOOL DISTRICT": "POLLOCK PINES ELEM",
    "REDDING SCHOOL DISTRICT": "REDDING ELEM",
    "RESCUE UNION": "RESCUE UNION ELEM",
    "ROSELAND SCHOOL DISTRICT": "ROSELAND",
    "SAN BERNARDINO COUNTY SUPERINTENDENT OF SCHOOLS": "SAN BERNARDINO COUNTY OFFICE OF EDUCATION",
    "SANTA CRUZ CITY SCHOOLS": "SANTA CRUZ CITY ELEM/HIGH",
    "SANTA ROSA CITY SCHOOLS": "SANTA ROSA ELEM-HIGH, CITY OF",
    "SANTEE SCHOOL DISTRICT": "SANTEE ELEM",
    "SIERRA PLUMAS JOINT UNIFIED": "SIERRA-PLUMAS JOINT UNF",
    "SILVER FORK SCHOOL DISTRICT": "SILVER FORK ELEM",
    "SOLVANG SCHOOL DISTRICT": "SOLVANG ELEM",
    "SOUTH COAST ROP": "SOUTH COAST REGIONAL OCCUPATIONAL PROGRAM",
    "SOUTH FORK UNION ELEMENTARY": "SOUTH FORK UNION",
    "SUNNYVALE SCHOOL DISTRICT": "SUNNYVALE",
    "TWAIN HARTE SCHOOL DISTRICT": "TWAIN HARTE",
    "WESTMINSTER SCHOOL DISTRICT": "WESTMINSTER ELEM",
    "WINSHIP-ROBBINS ESD": "WINSHIP-ROBBINS",
    "WINTON SCHOOL DISTRICT": "WINTON",
}

GA_SCHOOL_WORDS = ["BOARD OF EDUCATION", "SCHOOL", "ACADEMY", "KIPP", "CHARTER"]
GA_DROPPED_WORDS = [
    "BOARD OF EDUCATION", "SCHOOL SYSTEM", "SCHOOL DISTRICT", "ACADEMY", "CHARTER", "SCHOOL",
]
GA_DISTRICT_NAMES = {"ATLANTA INDEPENDENT": "ATLANTA PUBLIC SCHOOLS"}

KS_DROPPED_DISTRICTS = ["2010980"]
KS_REFERENCE_NAMES = [
    ("COLBY PUBLIC SCHOOLS", "COLBY"),
    ("HUTCHINSON PUBLIC SCHOOLS", "HUTCHINSON"),
    ("RILEY COUNTY", "RILEY"),
    ("SHAWNEE MISSION PUB SCH", "SHAWNEE MISSION"),
    ("TOPEKA PUBLIC SCHOOLS", "TOPEKA"),
]

NY_REFERENCE_NAMES = [
    ("city", ""),
    ("high school district", "school district"),
    ("csd", "central school district"),
    ("-", " "),
]
NY_RECORD_NAMES = [
    ("schools", "school district"),
    ("au sable", "ausable"),
    ("ford edward", "fort edward"),
    ("#", ""),
    ("public", ""),
    ("city", ""),
    ("-", " "),
]
NY_DROPPED_LOCAL_IDS = ["260501861002"]
NY_DROPPED_DISTRICTS = ["3601007"]

IN_DROPPED_ALIAS = "George and Victoria Phalen Leadership Academy"
IN_DROPPED_LOCAL_IDS = ["9770"]

WI_DROPPED_NAMES = [
    "SURING PUBLILC SCHOOL DISTRICT",
    "SEEDS OF HEALTH INC AGENCY",
    "MILWAUKEE COLLEGE PREPARATORY SCHOOL -- 36TH STREET AGENCY",
    "CEO LEADERSHIP ACADEMY AGENCY",
    "MILWAUKEE COLLEGE PREP SCHOOL: LOLA ROWE NORTH CAMPUS AGENCY",
]

# ---- the year in which the reference table prefixes its ids with the state

PREFIXED_REFERENCE_YEAR = 2017

# ---- source descriptions

SOURCES = {
    "NV": "Transparent Nevada (non-govt)",
    "IL": "IL Teacher Service Record",
    "IL2": "IL Employment Information System",
    "KS": "KS Open Gov (non-govt)",
    "MI": "Mackinac Center (non-govt)",
    "NY": "Empire Center for Public Policy (non-govt)",
    "ND": "ND Dept. of Ed",
    "OH": "OH_GOVT",
    "OK": "OK_DOE",
    "PA": "PA DOE",
    "WI": "WI DOE",
}

# ---- tenure by profession, published by the labour statistics office

TENURE_BY_PROFESSION = [
    ("Management occupations", 5.8),
    ("Business and financial operations occupations", 4.7),
    ("Computer and mathematical occupations", 3.9),
    ("Architecture and engineering occupations", 5.1),
    ("Life, physical, and social science occupations", 4.1),
    ("Community and social service occupations", 4.6),
    ("Legal occupations", 5.8),
    ("Education, training, and library occupations", 5.0),
    ("Arts, design, entertainment, sports, and media occupations", 3.4),
    ("Healthcare practitioners and technical occupations", 4.7),
]
