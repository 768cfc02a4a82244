"""The job advert that the golden results belong to, and those results."""

TEXT = """
Title: Junior Rust Developer

Job Description:

We are seeking a talented and motivated Junior Rust Developer to join our growing team. The ideal candidate will have a passion for programming, a strong foundation in Rust, and a desire to learn and grow in a dynamic work environment.

Responsibilities:

Assist in the development and maintenance of our core Rust applications
Write clean, efficient, and well-documented code
Collaborate with the development team to design and implement new features
Actively participate in code reviews and provide constructive feedback
Continuously learn and stay up-to-date with the latest Rust ecosystem trends and technologies

Requirements:

Bachelor's degree in Computer Science or related field, or equivalent experience
Proficiency in Rust programming language
Familiarity with version control systems, preferably Git
Strong problem-solving and debugging skills
Excellent written and verbal communication skills
Ability to work well in a team-oriented environment

Nice-to-Haves:

Experience with other programming languages, such as Python, JavaScript, or C++
Knowledge of database systems, like PostgreSQL or MongoDB
Familiarity with web development frameworks, such as Actix or Rocket

What We Offer:

Competitive salary and benefits package
Opportunity for growth and career advancement
Supportive and collaborative work environment
Chance to work on cutting-edge projects using Rust

If you are passionate about Rust development and looking to kickstart your career in a supportive and dynamic environment, we encourage you to apply!
"""

STOP_WORDS = "a about and are as date for have if in join latest like looking new of on or other our problem related such the to up using we web well what will with work you your".split()

SENTENCES = """
title junior rust developer
job description
seeking talented motivated junior rust developer growing team
ideal candidate passion programming strong foundation rust desire learn grow dynamic environment
responsibilities
assist development maintenance core rust applications
write clean efficient documented code
collaborate development team design implement features
actively participate code reviews provide constructive feedback
continuously learn stay rust ecosystem trends technologies
requirements
bachelor degree computer science field equivalent experience
proficiency rust programming language
familiarity version control systems preferably git
strong solving debugging skills
excellent written verbal communication skills
ability team oriented environment
nice haves
experience programming languages python javascript c
knowledge database systems postgresql mongodb
familiarity development frameworks actix rocket
offer
competitive salary benefits package
opportunity growth career advancement
supportive collaborative environment
chance cutting edge projects rust
passionate rust development kickstart career supportive dynamic environment encourage apply
""".strip().split("\n")

WORDS = """
title junior rust developer job description seeking talented motivated junior rust developer growing team ideal candidate passion programming strong
foundation rust desire learn grow dynamic environment responsibilities assist development maintenance core rust applications write clean efficient
documented code collaborate development team design implement features actively participate code reviews provide constructive feedback continuously
learn stay rust ecosystem trends technologies requirements bachelor degree computer science field equivalent experience proficiency rust programming
language familiarity version control systems preferably git strong solving debugging skills excellent written verbal communication skills ability team
oriented environment nice haves experience programming languages python javascript c knowledge database systems postgresql mongodb familiarity
development frameworks actix rocket offer competitive salary benefits package opportunity growth career advancement supportive collaborative
environment chance cutting edge projects rust passionate rust development kickstart career supportive dynamic environment encourage apply
""".split()

PARAGRAPHS = """
title junior rust developer
job description
seeking talented motivated junior rust developer growing team ideal candidate passion programming strong foundation rust desire learn grow dynamic environment
responsibilities
assist development maintenance core rust applications
write clean efficient documented code
collaborate development team design implement features
actively participate code reviews provide constructive feedback
continuously learn stay rust ecosystem trends technologies
requirements
bachelor degree computer science field equivalent experience
proficiency rust programming language
familiarity version control systems preferably git
strong solving debugging skills
excellent written verbal communication skills
ability team oriented environment
nice haves
experience programming languages python javascript c
knowledge database systems postgresql mongodb
familiarity development frameworks actix rocket
offer
competitive salary benefits package
opportunity growth career advancement
supportive collaborative environment
chance cutting edge projects rust
passionate rust development kickstart career supportive dynamic environment encourage apply
""".strip().split("\n")

TF_IDF_WORDS = """
rust development environment work programming team career code developer dynamic experience familiarity junior learn skills strong supportive systems
to well ability actively actix advancement applications apply assist bachelor benefits candidate chance clean collaborate collaborative communication
competitive computer constructive continuously control core cutting database date debugging degree description design desire documented ecosystem edge
efficient encourage equivalent excellent features feedback field foundation frameworks git grow growing growth haves ideal implement javascript job
join kickstart knowledge language languages latest like looking maintenance mongodb motivated new nice offer opportunity oriented package participate
passion passionate postgresql preferably problem proficiency projects provide python related requirements responsibilities
""".split()

RAKE_PHRASES = """
core rust applications write clean efficient
version control systems preferably git strong
title junior rust developer job description
provide constructive feedback continuously learn
motivated junior rust developer
debugging skills excellent written
technologies requirements bachelor degree
verbal communication skills ability
team oriented environment nice
rust programming language familiarity
""".strip().split("\n")

TEXT_RANK_WORDS = "rust environment development team programming code systems skills experience familiarity".split()

YAKE_KEYWORDS = """
motivated junior rust
motivated junior
job description
developer job description
rust developer
developer job
junior rust developer
rust developer job
junior rust
rust programming language
""".strip().split("\n")

CO_OCCURRENCE_WORDS = "rust development environment work programming team career code developer dynamic".split()
#: Rows of the matrix for a window of 10 (fixed values).
CO_OCCURRENCE_ROWS = {
    "rust": [0.6666667, 0.6666667, 0.6666667, 0.0, 1.0, 0.6666667, 0.33333334, 0.0, 1.0, 0.6666667],
    "development": [0.6666667, 0.0, 0.33333334, 0.0, 0.0, 0.33333334, 0.33333334, 0.0, 0.0, 0.33333334],
    "developer": [1.0, 0.0, 0.0, 0.0, 0.33333334, 0.33333334, 0.0, 0.0, 0.0, 0.0],
    "dynamic": [0.6666667, 0.33333334, 0.6666667, 0.0, 0.33333334, 0.0, 0.33333334, 0.0, 0.0, 0.0],
}
