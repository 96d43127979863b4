"""A small corpus with questions, to try an engine on: own texts, each about one thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: id, title, category, year, text.
DOCUMENTS = [
    ("bees", "Honey bees", "animals", 2019, "A honey bee colony has one queen and many thousand workers. Workers visit flowers and bring nectar and pollen to the hive. They tell each other where flowers are with a waggle dance."),
    ("owls", "Owls at night", "animals", 2020, "Owls hunt at night and hear very well. Their ears sit at different heights, so they can tell where a mouse rustles. Soft feathers make their flight almost silent."),
    ("salmon", "The way of the salmon", "animals", 2018, "Salmon hatch in rivers and grow up in the sea. After years they swim back to the river where they were born. They find it by its smell."),
    ("camels", "Camels", "animals", 2021, "Camels can go for many days without water. The hump stores fat and not water. Broad feet keep them from sinking into sand."),
    ("bread", "Baking bread", "food", 2017, "Bread dough is made of flour, water, salt and yeast. Yeast eats sugar and gives off gas, which makes the dough rise. A hot oven turns the outside into a crust."),
    ("cheese", "How cheese is made", "food", 2016, "Rennet makes milk curdle. The curd is cut, pressed and salted. Hard cheese ripens for months or years in a cool cellar."),
    ("tea", "Green and black tea", "food", 2022, "Green and black tea come from the same plant. Black tea leaves are left to oxidise before they are dried. Green tea leaves are heated at once, so they stay green."),
    ("olives", "Olive oil", "food", 2015, "Olives are picked in autumn and crushed with their stones. The paste is pressed, and oil is parted from water. Cold pressed oil keeps its taste."),
    ("bridges", "Kinds of bridges", "building", 2014, "A beam bridge rests on piers. An arch bridge carries its load to the sides. A suspension bridge hangs on cables between high towers and can span the longest gaps."),
    ("lighthouses", "Lighthouses", "building", 2013, "A lighthouse warns ships of rocks. Its lens bundles the light of a lamp into a narrow beam. Each lighthouse flashes in a rhythm of its own, so sailors can tell them apart."),
    ("windmills", "Windmills", "building", 2012, "Windmills ground grain and pumped water out of low land. The cap was turned so that the sails faced the wind. A miller could take cloth off the sails in a storm."),
    ("canals", "Canal locks", "building", 2011, "A canal lock lifts boats from one level to another. The gates close behind the boat, and water flows in through sluices. When both levels are equal the upper gates open."),
    ("moon", "The moon", "sky", 2020, "The moon circles the earth in about a month. It always shows us the same side. It has no air, so its sky is black even by day."),
    ("comets", "Comets", "sky", 2019, "A comet is a lump of ice and dust. Near the sun its ice turns to gas and makes a tail. The tail always points away from the sun."),
    ("aurora", "Northern lights", "sky", 2018, "Northern lights are seen near the poles. Particles from the sun follow the magnetic field of the earth. Where they hit oxygen the sky glows green."),
    ("eclipse", "Eclipses", "sky", 2017, "In an eclipse of the sun the moon stands before the sun. In an eclipse of the moon the earth throws its shadow on the moon. A copper red light then falls on the moon."),
    ("compass", "The compass", "tools", 2016, "A compass needle is a small magnet. It turns until it points north. Sailors used it when clouds hid the stars."),
    ("clocks", "Pendulum clocks", "tools", 2015, "A pendulum swings in even time, which depends on its length. A falling weight drives the wheels. The escapement lets them turn one tooth with each swing."),
    ("paper", "Making paper", "tools", 2014, "Paper is made of plant fibres in water. A sieve lifts them out as a thin sheet. The sheet is pressed and dried."),
    ("glass", "Glass", "tools", 2013, "Glass is melted from sand, soda and lime. A glass blower gathers it on a pipe and blows it into shape. It must cool slowly, or else it cracks."),
]

#: Question, ids of right documents, words that an answer should have.
QUESTIONS = [
    ("How do bees tell each other where flowers are?", ["bees"], ["dance"]), ("Why is the flight of owls silent?", ["owls"], ["feathers"]), ("How do salmon find their river?", ["salmon"], ["smell"]),
    ("What does the hump of a camel store?", ["camels"], ["fat"]), ("What makes bread dough rise?", ["bread"], ["yeast", "gas"]), ("What makes milk curdle for cheese?", ["cheese"], ["rennet"]),
    ("What is the difference between green tea and black tea?", ["tea"], ["oxidise"]), ("Which bridge can span the longest gaps?", ["bridges"], ["suspension"]), ("How can sailors tell lighthouses apart?", ["lighthouses"], ["rhythm"]),
    ("How does a canal lock lift boats?", ["canals"], ["gates", "water"]), ("Why is the sky of the moon black?", ["moon"], ["air"]), ("Where does the tail of a comet point?", ["comets"], ["sun"]),
    ("Why do northern lights glow green?", ["aurora"], ["oxygen"]), ("What happens in an eclipse of the moon?", ["eclipse"], ["shadow"]), ("Where does a compass needle point?", ["compass"], ["north"]),
    ("What drives the wheels of a pendulum clock?", ["clocks"], ["weight"]), ("What is glass melted from?", ["glass"], ["sand"]),
]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCUMENTS, "doc_id string, title string, category string, year int, text string")


def questions(spark: SparkSession) -> DataFrame:
    """qid, text, keywords."""
    return spark.createDataFrame([(i, q, words) for i, (q, _, words) in enumerate(QUESTIONS)], "qid int, text string, keywords array<string>")


def truth(spark: SparkSession) -> DataFrame:
    """qid, id."""
    return spark.createDataFrame([(i, d) for i, (_, ids, _) in enumerate(QUESTIONS) for d in ids], "qid int, id string")
