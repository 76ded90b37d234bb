"""Fixed values.

Word lists, thresholds, labels and lookup tables that decide results.  They are
plain data: every rule that uses them lives in a sibling module.  Row order
matters where a rule says "first match wins".
"""

from __future__ import annotations

# --- academic years, roles, subjects -----------------------------------------

FIRST_YEAR = "2019-2020"
LAST_YEAR = "2025-2026"
VALID_YEARS = [
    "2019-2020", "2020-2021", "2021-2022", "2022-2023",
    "2023-2024", "2024-2025", "2025-2026",
]
LIFETIME = "ALL"

ROLE_LABELS = {"P": "Parent", "T": "Teacher", "M": "Principal"}

PLACEHOLDER_SUBJECTS = [
    "New subject Regular", "new subject common code test", "SUBJECT_TEST2",
    "SubjectForRCTest", "New RC subject", "New sub for RC", "test",
]

# --- mark headings -------------------------------------------------------------

WRITTEN_HEADINGS = [1, 5, 15, 18, 19, 20, 25, 28, 33, 34, 36]
INTERNAL_HEADINGS = [2, 3, 4, 6, 7, 11, 21, 22, 23, 24, 26, 27, 30, 31, 32, 37, 38, 39, 40, 41]

# --- combined science ----------------------------------------------------------

SCIENCE_ID = 24
SCIENCE_NAME = "Science"
SCIENCE_TYPE = "Scholastic"
SCIENCE_CLASSES = ["6", "7", "8", "9", "10"]
SCIENCE_COMPONENTS = {15: "Physics", 16: "Chemistry", 17: "Biology"}
NOT_ASSESSED = " (not assessed)"

# --- class names ---------------------------------------------------------------

CLASS_SEQUENCE = ["nursery", "lkg", "ukg", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12"]
SENIOR_CLASSES = ["9", "10", "11", "12"]
ROMAN_CLASSES = {"ix": "9", "x": "10", "xi": "11", "xii": "12"}

# --- labels --------------------------------------------------------------------

ATTENDANCE_BANDS = [(90, "Highly Consistent"), (75, "Moderately Consistent")]
ATTENDANCE_BAND_ELSE = "Irregular"
STYLE_WRITTEN = "Conceptual / Written-Oriented"
STYLE_ORAL = "Experiential / Oral-Oriented"
STYLE_BALANCED = "Balanced"
ENGAGED = "Academically Engaged"
NOT_ENGAGED = "Low Visible Engagement"
AXIS_ACADEMIC = "Academic Excellence"
AXIS_ACTIVITY = "Co-Curricular Strength"
AXIS_ELSE = "Developing Potential"
TREND_FIRST = "Baseline Year"
TREND_UP = "Improving"
TREND_DOWN = "Declining"
TREND_SAME = "Stable"
TIERS = [(85, "⭐ Top Performer"), (65, "📈 On Track"), (50, "💪 Needs Support")]
TIER_ELSE = "🔴 Focus Area"
MEDALS = ["🥇", "🥈", "🥉", "4th", "5th"]
ZONE_BOTH = "Thriving"
ZONE_ACADEMIC = "Academically Strong"
ZONE_PRESENT = "Present & Growing"
ZONE_NEITHER = "Needs Support"
ATTENDANCE_BINS = ["<60", "60-75", "75-85", "85-90", ">=90"]
PRIORITY_URGENT = "Needs Urgent Help"
PRIORITY_SOME = "Needs Some Support"
STATUS_COMPLETE = "✅ Complete"
STATUS_NOT_RUN = "❌ ETL not run"
STATUS_PARTIAL = "⚠️  Partial"
UNCLASSIFIED = "UNCLASSIFIED ⚠️"
PRINCIPAL_WORDS = ["principal", "headmaster", "headmistress", "head master", "head mistress"]
NULL_WORDS = ["nan", "none", "nat", "n/a", ""]
COMM_ORAL = "stronger in oral/internal assessments (participative learner)"
COMM_WRITTEN = "stronger in written exams (independent studier)"
COMM_BALANCED = "balanced across oral and written assessments"

NO_DATA_MESSAGE = (
    "Not enough academic data is available yet. Once attendance, assessments, and subject performance are logged, "
    "a personalized learning profile will appear here."
)
WAITING_MESSAGE = "Academic data is still being collected. Check back after the next assessment cycle."

# --- required schema (table, columns) -------------------------------------------

REQUIRED_COLUMNS = [
    ("student_clean", ["student_id", "academic_yr"]),
    ("dim_student_demographics", ["student_id", "academic_yr", "student_name", "parent_id"]),
    ("dim_class", ["class_id", "class_name"]),
    ("dim_section", ["section_id", "section_name"]),
    ("dim_parent", ["parent_id", "father_name", "mother_name"]),
    ("dim_subject", ["subject_id", "subject_name"]),
    ("dim_users", ["user_id", "name", "reg_id", "role_id"]),
    ("dim_teachers", ["teacher_id", "name", "designation", "class_id", "section_id"]),
    ("student_master_profile", ["student_id", "academic_yr", "avg_percent"]),
    ("fact_attendance", ["student_id", "academic_yr", "attendance_percentage"]),
    ("fact_academics", ["student_id", "academic_yr", "avg_percent"]),
    ("fact_achievements", ["student_id", "academic_yr", "achievement_count"]),
    ("fact_homework_engagement", ["student_id", "academic_yr", "homework_assigned_count"]),
    ("fact_student_subject_performance", ["student_id", "academic_yr", "subject_id", "avg_percent"]),
    ("fact_science_components", ["student_id", "academic_yr", "component", "is_entered"]),
    ("student_behavior_signals", ["student_id", "academic_yr", "attendance_band"]),
]
REQUIRED_VIEWS = ["student_subject_strengths", "student_ai_profile", "child_selector"]
ECA_REQUIRED = ["student_id", "title", "category", "achievement_date", "level"]

# --- subject aliases and categories ---------------------------------------------

SUBJECT_ALIASES = {
    "mathematics": "Maths",
    "health & physical education": "Physical Education",
    "health and physical education": "Physical Education",
    "social science": "SST",
    "environmental studies": "EVS",
    "moral science": "G.K",
    "value education": "V.Ed",
}

SCHOLASTIC = "Scholastic"
SUBJECTS_BY_CATEGORY = {
    "Scholastic": [
        "english", "hindi", "marathi", "sanskrit", "maths", "mathematics",
        "mathematics regular", "applied mathematics", "science", "physics", "chemistry",
        "biology", "computer", "computer science", "computer applications",
        "artificial intelligence", "history", "civics", "geography", "political science",
        "economics", "accountancy", "business studies", "psychology", "social science",
        "sst", "evs", "gk",
    ],
    "Co-Scholastic": [
        "p.e.", "pt", "dance", "art & craft", "art/craft", "art & drawing", "art education",
        "music", "physical education", "health and fitness", "health & physical education",
        "games", "work education", "work educations (or pre-vocational education)",
        "general studies", "rhymes", "colouring", "story",
    ],
    "Social": ["library", "mpt", "cca"],
    "Optional": ["computer science (opt)", "psychology (opt)", "applied mathematics (opt)"],
}
CATEGORY_ABBREVIATIONS = {"Scholastic": "SC", "Co-Scholastic": "CS", "Social": "SO", "Optional": "OP"}
CATEGORY_ORDER = ["Scholastic", "Co-Scholastic", "Social", "Optional"]

# --- exams -----------------------------------------------------------------------

EXAM_NAMES = {
    "term 1": "Term 1",
    "term 2": "Term 2",
    "periodic test 1": "Periodic Test 1",
    "periodic test 2": "Periodic Test 2",
    "periodic test 2 (ix n x)": "Periodic Test 2",
    "periodic test 3": "Periodic Test 3",
    "periodic test 3 (ix)": "Periodic Test 3",
    "periodic test 1 (xi)": "Periodic Test 1",
    "unit test 2": "Unit Test 2",
    "unit test 3": "Unit Test 3",
    "unit test 3 (xi)": "Unit Test 3",
    "final exam": "Final Exam",
    "pre-board 1": "Pre-Board 1",
    "pre-board 2": "Pre-Board 2",
}

COMPONENT_RANKS = {
    "periodic test": 1, "term": 2, "written": 2, "pre-board": 2, "subject enrichment": 3,
    "multiple assessment": 4, "portfolio": 4, "oral": 3, "activity": 3, "practical": 2,
    "internal": 3, "reading": 2, "recitation": 3, "reading & recitation": 2,
    "conversation": 4, "rhymes": 3, "i can recognize": 1, "i can say": 2,
    "i can write(pattern)": 3, "i can say and recognise": 1,
}
COMPONENT_RANK_ELSE = 99

# --- remedial advice: subject, three focus points, action ------------------------

REMEDIAL = [
    ("english", "Reading comprehension", "Grammar & punctuation", "Essay writing",
     "Schedule weekly guided reading sessions with teacher"),
    ("hindi", "Reading comprehension", "Vyakaran (Grammar)", "Lekhan (Writing)",
     "Daily 15-min reading + weekly writing practice"),
    ("maths", "Core concept revision", "Problem-solving practice", "Formula recall",
     "Daily timed practice worksheets; seek teacher help for weak topics"),
    ("mathematics", "Core concept revision", "Problem-solving practice", "Formula recall",
     "Daily timed practice worksheets; seek teacher help for weak topics"),
    ("science", "Diagram labelling", "Concept revision", "Experiment notes",
     "Diagram-focused revision + lab notebook review"),
    ("physics", "Formula derivation", "Numerical practice", "Conceptual clarity",
     "Daily numerical practice; teacher support for derivations"),
    ("chemistry", "Equation balancing", "Periodic table recall", "Reaction types",
     "Flashcard reactions + periodic table drill"),
    ("biology", "Diagram labelling", "Process revision", "Key term recall",
     "Diagram drawing daily + concept note revision"),
    ("computer science", "Algorithm practice", "Code debugging", "Theory concepts",
     "Coding exercises daily + algorithm revision"),
    ("history", "Timeline practice", "Event cause & effect", "Key figure revision",
     "Timeline creation + chapter-wise summary notes"),
    ("geography", "Map practice", "Climate & landform revision", "Diagram work",
     "Daily map practice + diagram labelling exercises"),
    ("economics", "Graph interpretation", "Key term revision", "Numerical practice",
     "Graph practice + numerical problem sets daily"),
    ("accountancy", "Journal entry practice", "Balance sheet", "Trial balance",
     "Daily journal entry practice + teacher-led error correction"),
    ("social science", "Timeline practice", "Map practice", "Key term revision",
     "Map + timeline practice combined with key term revision"),
]
REMEDIAL_ELSE = ("Concept revision", "Practice exercises", "Clarify doubts with teacher",
                 "Attend extra support sessions and complete all assigned practice work")

# --- core subject families -------------------------------------------------------

CORE_SUBJECT_WORDS = [
    "Physics", "Chemistry", "Biology", "Biotechnology", "Zoology", "Botany", "Science",
    "Mathematics", "Maths", "Math", "Statistics", "Applied Mathematics",
    "English", "Hindi", "Sanskrit", "Tamil", "Telugu", "Marathi", "Urdu",
    "Computer Science", "Computer", "CS", "Information Technology", "IT",
    "Artificial Intelligence", "AI",
    "Economics", "History", "Geography", "Political Science", "Civics", "Psychology", "Sociology",
]

# --- subject to career, analysis page: subject word, career, reason ---------------

ANALYSIS_CAREERS = [
    ("physics", "Engineering (Mechanical / Electrical / Civil)", "Physics is the foundation of all engineering disciplines"),
    ("physics", "Astronomy & Astrophysics", "Physics is the core science behind space and planetary study"),
    ("physics", "Architecture", "Physics (structural mechanics) is essential for architectural design"),
    ("chemistry", "Medicine & Pharmacy", "Chemistry underpins pharmacology and medical diagnostics"),
    ("chemistry", "Chemical Engineering", "Chemistry is directly applied in industrial process design"),
    ("chemistry", "Biotechnology & Research", "Chemistry is essential for lab-based biological research"),
    ("biology", "Medicine & Healthcare (MBBS / Nursing)", "Biology is the primary subject for medical careers"),
    ("biology", "Biotechnology & Genetics", "Biology drives research in genetic engineering and life sciences"),
    ("biology", "Environmental Science", "Biology supports ecology and conservation management"),
    ("biotechnology", "Biotechnology & Pharmaceuticals", "Direct subject alignment with the biotech industry roles"),
    ("biotechnology", "Genetic Research", "Biotechnology is the foundation of molecular research"),
    ("science", "Medicine & Healthcare", "Science is the gateway to medical and health science careers"),
    ("science", "Engineering", "Science fundamentals underpin all engineering streams"),
    ("science", "Environmental Science", "Science supports ecology and environmental management"),
    ("zoology", "Veterinary Science", "Zoology directly supports animal medicine careers"),
    ("zoology", "Wildlife Biology & Conservation", "Zoology aligns with ecological field research"),
    ("botany", "Agriculture & Plant Science", "Botany supports crop science and agri-tech"),
    ("botany", "Environmental Conservation", "Botany is core to plant ecology and conservation"),
    ("mathematics", "Data Science & Analytics", "Mathematics is the backbone of data science and statistics"),
    ("mathematics", "Finance & Actuarial Science", "Strong Maths is required for banking and financial modelling"),
    ("mathematics", "Engineering", "Mathematics is essential across all engineering streams"),
    ("maths", "Data Science & Analytics", "Mathematics is the backbone of data science and statistics"),
    ("maths", "Finance & Actuarial Science", "Strong Maths is required for banking and financial modelling"),
    ("maths", "Engineering", "Mathematics is essential across all engineering streams"),
    ("applied mathematics", "Data Science & Analytics", "Applied Maths directly supports statistical and analytical roles"),
    ("applied mathematics", "Finance & Actuarial Science", "Applied Mathematics is core to financial modelling"),
    ("statistics", "Data Science & Analytics", "Statistics is the primary tool in machine learning and analysis"),
    ("statistics", "Economics & Policy Research", "Statistics is essential for economic modelling"),
    ("computer science", "Software Engineering & Development", "Computer Science directly prepares students for coding roles"),
    ("computer science", "Artificial Intelligence & Machine Learning", "CS is the gateway to AI/ML in the tech industry"),
    ("computer science", "Cybersecurity", "Computer Science covers the fundamentals of network security"),
    ("computer", "Software Engineering & Development", "Computer skills map directly to development careers"),
    ("computer", "IT Management & Systems Administration", "Computer knowledge supports enterprise system roles"),
    ("computer applications", "Software Development", "Computer Applications covers practical programming and systems work"),
    ("computer applications", "IT Support & Systems", "Computer Applications prepares students for IT operations roles"),
    ("information technology", "Software Development", "IT skills map directly to application and web development"),
    ("information technology", "IT Management & Systems Administration", "IT supports networking and enterprise system roles"),
    ("artificial intelligence", "AI/ML Engineering", "Direct subject alignment with the AI industry"),
    ("artificial intelligence", "Data Science", "AI coursework overlaps strongly with data science"),
    ("english", "Journalism & Media", "Strong English is essential for writing and broadcasting careers"),
    ("english", "Law", "Legal careers require precise written and verbal communication"),
    ("english", "Content & Communications", "English supports copywriting, PR, and content strategy"),
    ("hindi", "Journalism & Regional Media", "Hindi fluency supports regional news and publishing careers"),
    ("hindi", "Education & Teaching", "Hindi is a valued subject for teaching careers across India"),
    ("marathi", "Regional Journalism & Publishing", "Marathi supports regional media and literary careers"),
    ("marathi", "Education & Teaching (Marathi medium)", "Marathi qualifies students for teaching roles"),
    ("sanskrit", "Linguistics & Classical Studies", "Sanskrit is directly relevant to academic language study"),
    ("sanskrit", "Education & Teaching (Humanities)", "Sanskrit qualifies students for humanities teaching roles"),
    ("sanskrit", "Philosophy & Religious Studies", "Sanskrit is foundational for Indian philosophy and theology"),
    ("economics", "Finance & Banking", "Economics is directly aligned with banking and financial services"),
    ("economics", "Civil Services & Public Policy (IAS/IPS)", "Economics is a core subject for administrative roles"),
    ("economics", "Business Management (MBA)", "Economics provides analytical grounding for business careers"),
    ("history", "Civil Services & Public Administration", "History is a valued optional for IAS exams"),
    ("history", "Archaeology & Heritage Management", "History is the foundation for archaeological careers"),
    ("history", "Law", "Historical and constitutional knowledge supports legal studies"),
    ("geography", "Urban Planning & Civil Engineering", "Geography supports spatial planning and GIS careers"),
    ("geography", "Environmental Science & Conservation", "Geography is core to climate and ecology careers"),
    ("geography", "Geology & Earth Sciences", "Physical Geography is closely related to geological study"),
    ("political science", "Civil Services (IAS/IPS/IFS)", "Political Science is the most directly aligned subject for admin careers"),
    ("political science", "Law & Governance", "Political Science supports legal and policy careers"),
    ("political science", "Journalism & Policy Analysis", "Political Science is essential for political reporting"),
    ("civics", "Civil Services", "Civics is foundational for public administration careers"),
    ("civics", "Law & Governance", "Civics knowledge directly supports legal study"),
    ("social science", "Civil Services & Public Administration", "Social Science is core to administrative and policy careers"),
    ("social science", "Journalism & Research", "Social Science supports qualitative research and reporting"),
    ("psychology", "Clinical Psychology & Counselling", "Psychology is the direct pathway to mental health careers"),
    ("psychology", "Human Resources & Organisational Behaviour", "Psychology supports people management roles"),
    ("psychology", "Education & Special Needs Teaching", "Psychology is foundational for educational support roles"),
    ("sociology", "Social Work & NGO Sector", "Sociology is the core subject for community development careers"),
    ("sociology", "Civil Services", "Sociology is a popular optional for UPSC exams"),
    ("sociology", "Research & Journalism", "Sociology supports qualitative research and investigative journalism"),
    ("accountancy", "Chartered Accountancy (CA) & Auditing", "Accountancy is the direct pathway to CA careers"),
    ("accountancy", "Finance & Banking", "Accountancy skills are foundational for financial management"),
    ("business studies", "Business Management & Entrepreneurship", "Business Studies directly supports MBA and startup careers"),
    ("business studies", "Marketing & Sales", "Business Studies covers market research and sales strategy"),
    ("art", "Graphic Design & Visual Communication", "Art skills are directly applicable to design and branding"),
    ("art", "Architecture", "Art and spatial thinking are foundational for architecture"),
    ("art", "Animation & Game Design", "Art is a core requirement for digital media careers"),
    ("art & drawing", "Graphic Design & Visual Communication", "Drawing skills are directly applicable to design careers"),
    ("art & drawing", "Animation & Illustration", "Art & Drawing is the foundation for animation and visual storytelling"),
    ("art & drawing", "Architecture", "Drawing and spatial reasoning are core skills in architectural study"),
    ("art & craft", "Graphic Design & Visual Communication", "Art & Craft skills support design and creative industry careers"),
    ("art & craft", "Product Design", "Craft skills are foundational for industrial and product design"),
    ("physical education", "Sports Coaching & Athletic Training", "Physical Education directly supports coaching careers"),
    ("physical education", "Physiotherapy & Sports Medicine", "PE is a strong foundation for physiotherapy careers"),
    ("music", "Performing Arts & Music Production", "Music is directly aligned with performance and production careers"),
    ("music", "Music Education & Therapy", "Music qualifications support teaching and therapy roles"),
    ("dance", "Performing Arts & Choreography", "Dance directly supports performance and choreography careers"),
    ("dance", "Physical Education & Wellness", "Dance training supports fitness and wellness industry roles"),
    ("evs", "Environmental Science", "EVS is the foundation for ecology and conservation careers"),
    ("evs", "Primary Education & Teaching", "EVS is a core subject for primary school teaching roles"),
    ("gk", "Civil Services & Administration", "General Knowledge is essential for competitive exam preparation"),
    ("gk", "Journalism & Media", "Broad general knowledge is a core asset for journalism careers"),
]

# --- subject to career, insight text: subject word, career, reason ----------------

INSIGHT_CAREERS = [
    ("physics", "Engineering (Mechanical, Electrical, Civil)", "Physics is the foundation of all engineering disciplines"),
    ("physics", "Astronomy & Astrophysics", "Physics is the core science behind space and planetary study"),
    ("physics", "Research & Academics", "Strong Physics skills suit university research and teaching"),
    ("chemistry", "Medicine & Pharmacy", "Chemistry underpins pharmacology, drug development, and medical diagnostics"),
    ("chemistry", "Chemical Engineering", "Chemistry is directly applied in industrial process and materials design"),
    ("chemistry", "Biotechnology & Research", "Chemistry is essential for lab-based biological research"),
    ("biology", "Medicine & Healthcare (MBBS, Nursing)", "Biology is the primary subject for medical and health science careers"),
    ("biology", "Biotechnology & Genetics", "Biology drives research in genetic engineering and life sciences"),
    ("biology", "Environmental Science", "Biology supports ecology, conservation, and environmental management"),
    ("biotechnology", "Biotechnology & Pharmaceuticals", "Direct subject alignment with biotech industry roles"),
    ("biotechnology", "Genetic Research", "Biotechnology is the foundation of genetic and molecular research"),
    ("zoology", "Veterinary Science", "Zoology directly supports animal medicine and wildlife careers"),
    ("zoology", "Wildlife Biology & Conservation", "Zoology aligns with ecological field research"),
    ("botany", "Agriculture & Plant Science", "Botany supports crop science, horticulture, and agri-tech"),
    ("botany", "Environmental Conservation", "Botany is core to plant ecology and conservation work"),
    ("mathematics", "Data Science & Analytics", "Mathematics (statistics, algebra) is the backbone of data science"),
    ("mathematics", "Finance & Actuarial Science", "Strong Maths skills are required for banking, insurance, and financial modelling"),
    ("mathematics", "Engineering", "Mathematics is essential across all engineering streams"),
    ("maths", "Data Science & Analytics", "Mathematics (statistics, algebra) is the backbone of data science"),
    ("maths", "Finance & Actuarial Science", "Strong Maths skills are required for banking, insurance, and financial modelling"),
    ("statistics", "Data Science & Analytics", "Statistics is the primary tool in data analysis and machine learning"),
    ("statistics", "Economics & Policy Research", "Statistics is essential for economic modelling and public policy analysis"),
    ("computer science", "Software Engineering & Development", "Computer Science directly prepares students for coding and system design"),
    ("computer science", "Artificial Intelligence & Machine Learning", "CS is the gateway to AI/ML roles in the tech industry"),
    ("computer science", "Cybersecurity", "Computer Science covers the fundamentals of network security"),
    ("information technology", "Software Development", "IT skills map directly to application and web development careers"),
    ("information technology", "IT Management & Systems Administration", "IT supports infrastructure, networking, and enterprise system roles"),
    ("artificial intelligence", "AI/ML Engineering", "Direct subject alignment with the AI and machine learning industry"),
    ("artificial intelligence", "Data Science", "AI coursework overlaps strongly with data science and analytics"),
    ("english", "Journalism & Media", "Strong English is essential for writing, reporting, and broadcasting"),
    ("english", "Law", "Legal careers require precise written and verbal communication in English"),
    ("english", "Content & Communications", "English proficiency supports copywriting, PR, and content strategy roles"),
    ("hindi", "Journalism & Regional Media", "Hindi fluency supports careers in regional news, publishing, and broadcasting"),
    ("hindi", "Education & Teaching", "Hindi is a valued subject for teaching careers across India"),
    ("sanskrit", "Linguistics & Classical Studies", "Sanskrit is directly relevant to academic study of language and ancient texts"),
    ("sanskrit", "Education & Teaching (Sanskrit/Humanities)", "Sanskrit qualifies students for teaching roles in humanities"),
    ("sanskrit", "Philosophy & Religious Studies", "Sanskrit is foundational for studying Indian philosophy and theology"),
    ("economics", "Finance & Banking", "Economics is directly aligned with banking, investment, and financial services"),
    ("economics", "Public Policy & Civil Services (IAS/IPS)", "Economics is a core subject for administrative and policy roles"),
    ("economics", "Business Management (MBA)", "Economics provides strong analytical grounding for business careers"),
    ("history", "Civil Services & Public Administration", "History is a valued optional subject for IAS and administrative exams"),
    ("history", "Archaeology & Heritage Management", "History is the foundation for archaeological and museum careers"),
    ("history", "Law", "Historical and constitutional knowledge supports legal studies"),
    ("geography", "Urban Planning & Civil Engineering", "Geography supports spatial planning, infrastructure, and GIS careers"),
    ("geography", "Environmental Science & Conservation", "Geography is core to climate, ecology, and environmental management"),
    ("geography", "Geology & Earth Sciences", "Physical Geography is closely related to geological and earth science study"),
    ("political science", "Civil Services (IAS/IPS/IFS)", "Political Science is the most directly aligned subject for administrative careers"),
    ("political science", "Law & Governance", "Political Science supports legal and policy careers"),
    ("political science", "Journalism & Policy Analysis", "Political Science is essential for political reporting and think-tank roles"),
    ("psychology", "Clinical Psychology & Counselling", "Psychology is the direct pathway to mental health and counselling careers"),
    ("psychology", "Human Resources & Organisational Behaviour", "Psychology supports people management and HR roles"),
    ("psychology", "Education & Special Needs Teaching", "Psychology is foundational for child development and educational support"),
    ("sociology", "Social Work & NGO Sector", "Sociology is the core subject for social welfare and community development"),
    ("sociology", "Civil Services", "Sociology is a popular optional for UPSC and state civil service exams"),
    ("sociology", "Research & Journalism", "Sociology supports qualitative research and investigative journalism"),
    ("accountancy", "Chartered Accountancy (CA) & Auditing", "Accountancy is the direct pathway to CA and financial audit careers"),
    ("accountancy", "Finance & Banking", "Accountancy skills are foundational for banking and financial management"),
    ("business studies", "Business Management & Entrepreneurship", "Business Studies directly supports MBA and startup careers"),
    ("business studies", "Marketing & Sales", "Business Studies covers market research, branding, and sales strategy"),
    ("art", "Graphic Design & Visual Communication", "Art skills are directly applicable to design, illustration, and branding"),
    ("art", "Architecture", "Art and spatial thinking are foundational for architecture studies"),
    ("art", "Animation & Game Design", "Art is a core requirement for careers in digital media and gaming"),
    ("physical education", "Sports Coaching & Athletic Training", "Physical Education directly supports coaching and sports science careers"),
    ("physical education", "Physiotherapy & Sports Medicine", "PE is a strong foundation for physiotherapy and rehabilitation careers"),
    ("music", "Performing Arts & Music Production", "Music is directly aligned with performance, composition, and production careers"),
    ("music", "Music Education & Therapy", "Music qualifications support teaching and music therapy roles"),
]

# --- achievement words: word, category, signal ------------------------------------

ACHIEVEMENT_CATEGORIES = [
    ("cricket", "Sports & Athletics", "Cricket signals physical discipline and team strategy"),
    ("football", "Sports & Athletics", "Football signals teamwork and physical fitness"),
    ("basketball", "Sports & Athletics", "Basketball signals coordination and team play"),
    ("badminton", "Sports & Athletics", "Badminton signals agility and competitive drive"),
    ("tennis", "Sports & Athletics", "Tennis signals precision and competitive sport potential"),
    ("swimming", "Sports & Athletics", "Swimming signals endurance and athletic discipline"),
    ("athletics", "Sports & Athletics", "Athletics signals physical training and competitive sport"),
    ("kho kho", "Sports & Athletics", "Kho-Kho signals team coordination and agility"),
    ("kabaddi", "Sports & Athletics", "Kabaddi signals strength and team sport potential"),
    ("chess", "Strategy & Academics", "Chess signals analytical thinking and strategic planning"),
    ("sport", "Sports & Athletics", "Sports participation signals discipline and teamwork"),
    ("dance", "Performing Arts", "Dance signals creativity, discipline, and performance ability"),
    ("singing", "Performing Arts", "Singing signals musical talent and stage confidence"),
    ("music", "Performing Arts", "Music signals creative expression and discipline"),
    ("drama", "Performing Arts", "Drama signals communication skills and creative expression"),
    ("theatre", "Performing Arts", "Theatre signals stage presence and storytelling ability"),
    ("cultural", "Performing Arts", "Cultural events signal artistic interest and engagement"),
    ("skit", "Performing Arts", "Skit performance signals communication and dramatic expression"),
    ("art", "Visual Arts & Design", "Art signals visual creativity and design potential"),
    ("drawing", "Visual Arts & Design", "Drawing signals visual arts talent and design aptitude"),
    ("painting", "Visual Arts & Design", "Painting signals creative expression and fine arts potential"),
    ("craft", "Visual Arts & Design", "Craft signals hands-on creativity and design skills"),
    ("poster", "Visual Arts & Design", "Poster-making signals visual communication and design thinking"),
    ("rangoli", "Visual Arts & Design", "Rangoli signals cultural creativity and visual design ability"),
    ("quiz", "Academic Excellence", "Quiz signals broad knowledge and academic curiosity"),
    ("olympiad", "Academic Excellence", "Olympiad signals advanced subject mastery and ambition"),
    ("essay", "Communication & Writing", "Essay writing signals language proficiency and critical thinking"),
    ("debate", "Communication & Writing", "Debate signals communication, persuasion, and analytical skills"),
    ("elocution", "Communication & Writing", "Elocution signals public speaking and language confidence"),
    ("speech", "Communication & Writing", "Speech competition signals communication ability"),
    ("spelling", "Communication & Writing", "Spelling signals language precision and vocabulary breadth"),
    ("leadership", "Leadership & Organisation", "Leadership signals initiative and organisational ability"),
    ("prefect", "Leadership & Organisation", "Prefect role signals leadership and peer respect"),
    ("captain", "Leadership & Organisation", "Captain role signals leadership and team motivation"),
    ("monitor", "Leadership & Organisation", "Monitor role signals responsibility and peer trust"),
    ("head boy", "Leadership & Organisation", "Head Boy signals exceptional leadership"),
    ("head girl", "Leadership & Organisation", "Head Girl signals exceptional leadership"),
]

# --- achievement words to skills, skills to careers --------------------------------

ACHIEVEMENT_SKILLS = [
    ("football", "athletic discipline"), ("football", "teamwork"),
    ("cricket", "athletic discipline"), ("cricket", "teamwork"),
    ("sports", "athletic discipline"),
    ("music", "creativity"), ("music", "performance confidence"),
    ("dance", "creativity"), ("dance", "performance confidence"),
    ("art", "creativity"), ("art", "visual thinking"),
    ("drawing", "creativity"), ("drawing", "visual thinking"),
    ("debate", "communication"), ("debate", "argumentation"), ("debate", "leadership"),
    ("speech", "communication"),
    ("public speaking", "communication"),
    ("olympiad", "analytical ability"), ("olympiad", "problem solving"),
    ("science fair", "analytical ability"), ("science fair", "scientific curiosity"),
    ("coding", "logical thinking"), ("coding", "problem solving"),
    ("robotics", "engineering mindset"), ("robotics", "problem solving"),
    ("volunteer", "empathy"), ("volunteer", "social responsibility"),
]

SKILL_CAREERS = [
    ("analytical ability", "Engineering", "Analytical thinking supports engineering problem solving"),
    ("analytical ability", "Data Science", "Analytical ability aligns with statistical reasoning"),
    ("problem solving", "Software Engineering", "Problem solving is central to software design"),
    ("problem solving", "Artificial Intelligence", "AI research relies on strong problem solving"),
    ("communication", "Law", "Strong communication is essential for legal careers"),
    ("communication", "Journalism", "Communication skills support journalism and media"),
    ("leadership", "Business Management", "Leadership supports management roles"),
    ("leadership", "Civil Services", "Leadership aligns with administrative careers"),
    ("creativity", "Graphic Design", "Creativity directly supports visual design careers"),
    ("creativity", "Architecture", "Creative spatial thinking supports architecture"),
    ("visual thinking", "Architecture", "Visual thinking is essential for architectural design"),
    ("visual thinking", "Animation & Game Design", "Visual imagination supports animation careers"),
    ("athletic discipline", "Professional Sports", "Athletic discipline supports sports careers"),
    ("athletic discipline", "Sports Coaching", "Sports experience supports coaching pathways"),
    ("teamwork", "Business Management", "Team collaboration skills support management"),
    ("scientific curiosity", "Scientific Research", "Curiosity drives research careers"),
    ("scientific curiosity", "Biotechnology", "Scientific curiosity aligns with biotech fields"),
]

# --- career goals: goal words in order, subjects needed ------------------------------

GOAL_SUBJECTS = [
    ("doctor", "Biology, Chemistry, Physics"), ("physician", "Biology, Chemistry, Physics"),
    ("surgeon", "Biology, Chemistry, Physics"), ("medicine", "Biology, Chemistry, Physics"),
    ("mbbs", "Biology, Chemistry, Physics"), ("nurse", "Biology, Chemistry"),
    ("nursing", "Biology, Chemistry"), ("pharmacist", "Chemistry, Biology, Mathematics"),
    ("pharmacy", "Chemistry, Biology, Mathematics"), ("dentist", "Biology, Chemistry, Physics"),
    ("physiotherapist", "Biology, Physical Education"), ("veterinarian", "Biology, Chemistry, Zoology"),
    ("vet", "Biology, Chemistry, Zoology"), ("engineer", "Physics, Mathematics, Chemistry"),
    ("engineering", "Physics, Mathematics, Chemistry"), ("mechanical", "Physics, Mathematics"),
    ("electrical", "Physics, Mathematics"), ("civil engineer", "Physics, Mathematics, Geography"),
    ("software engineer", "Computer Science, Mathematics"), ("software", "Computer Science, Mathematics"),
    ("programmer", "Computer Science, Mathematics"), ("coder", "Computer Science, Mathematics"),
    ("developer", "Computer Science, Mathematics"), ("web developer", "Computer Science, Mathematics"),
    ("app developer", "Computer Science, Mathematics"), ("robotics", "Physics, Mathematics, Computer Science"),
    ("cybersecurity", "Computer Science, Mathematics"),
    ("data scientist", "Mathematics, Statistics, Computer Science"),
    ("data science", "Mathematics, Statistics, Computer Science"),
    ("data analyst", "Mathematics, Statistics, Computer Science"),
    ("actuary", "Mathematics, Statistics, Economics"), ("banker", "Economics, Mathematics, Accountancy"),
    ("banking", "Economics, Mathematics, Accountancy"), ("ca", "Accountancy, Mathematics, Economics"),
    ("chartered accountant", "Accountancy, Mathematics, Economics"), ("accountant", "Accountancy, Mathematics"),
    ("economist", "Economics, Mathematics, Statistics"), ("finance", "Economics, Mathematics, Accountancy"),
    ("investment", "Economics, Mathematics, Statistics"), ("lawyer", "English, Political Science, History"),
    ("advocate", "English, Political Science, History"), ("law", "English, Political Science, History"),
    ("judge", "English, Political Science, History"),
    ("ias", "History, Geography, Political Science, Economics"),
    ("ips", "History, Geography, Political Science, Economics"),
    ("civil services", "History, Geography, Political Science, Economics"),
    ("upsc", "History, Geography, Political Science, Economics"),
    ("diplomat", "History, Political Science, Economics, English"),
    ("politician", "Political Science, History, Economics"), ("architect", "Mathematics, Art, Physics"),
    ("architecture", "Mathematics, Art, Physics"), ("artist", "Art, Art & Drawing, Art & Craft"),
    ("painter", "Art, Art & Drawing, Art & Craft"), ("sculptor", "Art, Art & Drawing"),
    ("designer", "Art, Art & Drawing, Mathematics"),
    ("graphic designer", "Art, Art & Drawing, Computer Science"), ("fashion designer", "Art, Art & Drawing"),
    ("interior designer", "Art, Mathematics"), ("animator", "Art, Art & Drawing, Computer Science"),
    ("illustrator", "Art, Art & Drawing"), ("game designer", "Art, Computer Science, Mathematics"),
    ("photographer", "Art, Art & Drawing"), ("journalist", "English, Political Science, History"),
    ("reporter", "English, Political Science, History"), ("anchor", "English, Hindi"),
    ("actor", "English, Hindi"), ("actress", "English, Hindi"), ("filmmaker", "Art, English"),
    ("film maker", "Art, English"), ("director", "Art, English"), ("writer", "English, Hindi"),
    ("author", "English, Hindi"), ("content creator", "English, Computer Science"),
    ("youtuber", "English, Computer Science"), ("teacher", "The subject you want to teach + English"),
    ("professor", "The subject you want to teach + English"), ("psychologist", "Psychology, Biology, English"),
    ("counsellor", "Psychology, English, Sociology"), ("social worker", "Sociology, Psychology, English"),
    ("scientist", "Physics, Chemistry, Biology, Mathematics"), ("biologist", "Biology, Chemistry, Mathematics"),
    ("chemist", "Chemistry, Biology, Mathematics"), ("physicist", "Physics, Mathematics"),
    ("astronomer", "Physics, Mathematics"), ("astronaut", "Physics, Mathematics, Biology"),
    ("geologist", "Geography, Physics, Chemistry"), ("geology", "Geography, Physics, Chemistry"),
    ("environmentalist", "Biology, Geography, Chemistry"), ("botanist", "Botany, Biology, Chemistry"),
    ("zoologist", "Zoology, Biology, Chemistry"), ("cricketer", "Physical Education, Mathematics"),
    ("cricket", "Physical Education, Mathematics"), ("footballer", "Physical Education"),
    ("football", "Physical Education"), ("athlete", "Physical Education, Biology"),
    ("sports", "Physical Education, Biology"), ("coach", "Physical Education, Psychology"),
    ("fitness trainer", "Physical Education, Biology"), ("chef", "Chemistry, Home Science"),
    ("cook", "Chemistry, Home Science"), ("hotel management", "English, Business Studies, Home Science"),
    ("hospitality", "English, Business Studies"), ("tourism", "Geography, English, History"),
    ("entrepreneur", "Business Studies, Economics, Mathematics"),
    ("business", "Business Studies, Economics, Mathematics"),
    ("marketing", "Business Studies, Economics, English"), ("musician", "Music"), ("singer", "Music"),
    ("dancer", "Dance, Physical Education"), ("choreographer", "Dance, Physical Education"),
    ("pilot", "Physics, Mathematics"), ("aviation", "Physics, Mathematics"),
    ("army", "Physics, Mathematics, Geography"), ("defence", "Physics, Mathematics, Geography"),
]
