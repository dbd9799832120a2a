"""Catalogs and prompt texts of the four task worlds.  All tables here are fixed values."""

from __future__ import annotations

# --- fixed values ------------------------------------------------------------------------------------------
# city | city_en | name | name_en | type | type_en | place | audience | hours | lei
ATTRACTIONS = """
Brașov | Brasov | Biserica Neagră | The Black Church | monument | monument | indoor | family | 1.5 | 25
Brașov | Brasov | Parcul Central | Central Park | parc | park | outdoor | family | 2.0 | 0
Brașov | Brasov | Pârtia Poiana Brașov | Poiana Brasov Ski Slope | sport | sports | outdoor | adults | 4.0 | 150
Brașov | Brasov | Muzeul de Istorie | History Museum | muzeu | museum | indoor | family | 2.0 | 20
Brașov | Brasov | Telecabina Tâmpa | Tampa Cable Car | transport | transport | outdoor | family | 1.0 | 22
Brașov | Brasov | Turnul Alb | The White Tower | monument | monument | outdoor | family | 1.0 | 10
Brașov | Brasov | Casa Sfatului | The Council House | monument | monument | indoor | family | 1.5 | 15
Cluj-Napoca | Cluj-Napoca | Grădina Botanică | Botanical Garden | parc | park | outdoor | family | 2.0 | 15
Cluj-Napoca | Cluj-Napoca | Muzeul Național de Artă | National Art Museum | muzeu | museum | indoor | family | 2.0 | 20
Cluj-Napoca | Cluj-Napoca | Cetățuia | Cetatuia Hill Fortress | monument | monument | outdoor | family | 1.5 | 0
Cluj-Napoca | Cluj-Napoca | Parcul Central Simion Bărnuțiu | Central Park | parc | park | outdoor | family | 1.5 | 0
Cluj-Napoca | Cluj-Napoca | Muzeul Etnografic al Transilvaniei | Ethnographic Museum of Transylvania | muzeu | museum | indoor | family | 2.5 | 25
Cluj-Napoca | Cluj-Napoca | Biserica Sfântul Mihail | St. Michael's Church | monument | monument | indoor | family | 1.0 | 0
Sibiu | Sibiu | Piața Mare | Grand Square | piață | square | outdoor | family | 1.5 | 0
Sibiu | Sibiu | Muzeul Brukenthal | Brukenthal Museum | muzeu | museum | indoor | family | 2.5 | 30
Sibiu | Sibiu | Podul Minciunilor | Bridge of Lies | monument | monument | outdoor | family | 0.5 | 0
Sibiu | Sibiu | Turnul Sfatului | Council Tower | monument | monument | indoor | family | 1.0 | 10
Sibiu | Sibiu | Grădina Zoologică | Zoo | parc | park | outdoor | family | 3.0 | 25
Sibiu | Sibiu | Muzeul ASTRA | ASTRA Open-Air Museum | muzeu | museum | outdoor | family | 4.0 | 35
Timișoara | Timisoara | Piața Victoriei | Victory Square | piață | square | outdoor | family | 1.5 | 0
Timișoara | Timisoara | Catedrala Mitropolitană | Metropolitan Cathedral | monument | monument | indoor | family | 1.0 | 0
Timișoara | Timisoara | Parcul Rozelor | Rose Park | parc | park | outdoor | family | 2.0 | 0
Timișoara | Timisoara | Muzeul de Artă | Art Museum | muzeu | museum | indoor | family | 2.0 | 20
Timișoara | Timisoara | Bastionul Theresia | Theresia Bastion | monument | monument | indoor | adults | 1.5 | 15
Timișoara | Timisoara | Grădina Zoologică Timișoara | Timisoara Zoo | parc | park | outdoor | family | 3.0 | 20
Iași | Iasi | Palatul Culturii | Palace of Culture | monument | monument | indoor | family | 3.0 | 30
Iași | Iasi | Grădina Botanică Iași | Iasi Botanical Garden | parc | park | outdoor | family | 2.5 | 15
Iași | Iasi | Mănăstirea Trei Ierarhi | Three Hierarchs Monastery | monument | monument | indoor | family | 1.0 | 0
Iași | Iasi | Teatrul Național Iași | Iasi National Theatre | monument | monument | indoor | family | 0.5 | 0
Iași | Iasi | Parcul Copou | Copou Park | parc | park | outdoor | family | 2.0 | 0
Iași | Iasi | Casa Memorială Mihai Eminescu | Mihai Eminescu Memorial House | muzeu | museum | indoor | family | 1.5 | 10
Constanța | Constanta | Cazinoul din Constanța | Constanta Casino | monument | monument | outdoor | family | 1.0 | 0
Constanța | Constanta | Muzeul de Istorie și Arheologie | History and Archaeology Museum | muzeu | museum | indoor | family | 2.0 | 20
Constanța | Constanta | Delfinariul | Dolphinarium | parc | park | indoor | family | 2.0 | 45
Constanța | Constanta | Plaja Modern | Modern Beach | plajă | beach | outdoor | family | 4.0 | 0
Constanța | Constanta | Acvariul Constanța | Constanta Aquarium | muzeu | museum | indoor | family | 1.5 | 30
Constanța | Constanta | Farul Genovez | Genoese Lighthouse | monument | monument | outdoor | family | 0.5 | 0
"""

# meal | meal_en | name | name_en | tags | minutes | kcal
DISHES = """
mic_dejun | breakfast | Ouă jumări cu roșii | Scrambled Eggs with Tomatoes | vegetarian | 15 | 250
mic_dejun | breakfast | Mămăligă cu brânză și smântână | Polenta with Cheese and Sour Cream | vegetarian lactose | 25 | 400
mic_dejun | breakfast | Clătite cu gem | Pancakes with Jam | vegetarian gluten lactose | 30 | 350
mic_dejun | breakfast | Sandviș cu brânză și legume | Cheese and Vegetable Sandwich | vegetarian gluten lactose | 10 | 300
mic_dejun | breakfast | Iaurt cu fructe și granola | Yogurt with Fruit and Granola | vegetarian gluten lactose | 5 | 280
mic_dejun | breakfast | Smoothie verde cu spanac | Green Spinach Smoothie | vegetarian vegan | 10 | 180
pranz | lunch | Ciorbă de legume | Vegetable Soup | vegetarian vegan | 45 | 200
pranz | lunch | Sarmale în foi de viță | Stuffed Cabbage Rolls | - | 120 | 450
pranz | lunch | Tocană de cartofi cu carne | Potato and Meat Stew | - | 60 | 500
pranz | lunch | Salată grecească | Greek Salad | vegetarian lactose | 15 | 250
pranz | lunch | Paste cu sos de roșii | Pasta with Tomato Sauce | vegetarian vegan gluten | 25 | 380
pranz | lunch | Piept de pui la grătar cu legume | Grilled Chicken Breast with Vegetables | - | 35 | 350
pranz | lunch | Mâncare de fasole | Bean Stew | vegetarian vegan | 50 | 320
cina | dinner | Supă cremă de ciuperci | Cream of Mushroom Soup | vegetarian lactose | 40 | 220
cina | dinner | Orez cu legume | Rice with Vegetables | vegetarian vegan | 30 | 300
cina | dinner | Omletă cu ciuperci și brânză | Mushroom and Cheese Omelette | vegetarian lactose | 20 | 280
cina | dinner | Pește la cuptor cu cartofi | Baked Fish with Potatoes | - | 50 | 400
cina | dinner | Salată de ton | Tuna Salad | - | 15 | 280
cina | dinner | Wrap vegetarian | Vegetarian Wrap | vegetarian vegan gluten | 15 | 320
"""

# category | key | question_ro | question_en | answer | common misbelief
FACTS = """
geography | capital_romania | Care este capitala României? | What is the capital of Romania? | București | Sibiu
geography | capital_germany | Care este capitala Germaniei? | What is the capital of Germany? | Berlin | Frankfurt
geography | danube_flows | În ce mare se varsă Dunărea? | Which sea does the Danube flow into? | Marea Neagră | Marea Caspică
geography | longest_river_romania | Care este cel mai lung râu din România? | What is the longest river in Romania? | Dunărea | Mureșul
geography | highest_peak_romania | Care este cel mai înalt vârf din România? | What is the highest peak in Romania? | Moldoveanu (2544m) | Negoiu (2535m)
geography | neighbors_romania | Câte țări sunt vecine cu România? | How many countries border Romania? | 5 (Ucraina, Moldova, Bulgaria, Serbia, Ungaria) | 4 țări
history | romania_independence | În ce an și-a proclamat România independența? | In what year did Romania declare independence? | 1877 | 1878
history | romania_eu | În ce an a aderat România la Uniunea Europeană? | In what year did Romania join the European Union? | 2007 | 2004
history | first_king | Cine a fost primul rege al României? | Who was the first king of Romania? | Carol I | Alexandru Ioan Cuza
history | great_union | În ce an s-a realizat Marea Unire? | In what year did the Great Union take place? | 1918 | 1920
culture | national_poet | Cine este poetul național al României? | Who is the national poet of Romania? | Mihai Eminescu | George Coșbuc
culture | national_day | Când este ziua națională a României? | When is Romania's national day? | 1 Decembrie | 24 Ianuarie
culture | currency_romania | Care este moneda națională a României? | What is the national currency of Romania? | Leul (RON) | Euro
science | water_boiling | La ce temperatură fierbe apa la presiune normală? | At what temperature does water boil at normal pressure? | 100°C | 85°C
science | speed_of_light | Care este viteza luminii în vid? | What is the speed of light in vacuum? | aproximativ 300.000 km/s | -
general | population_romania | Care este populația aproximativă a României? | What is the approximate population of Romania? | aproximativ 19 milioane | -
general | capital_population | Care este populația aproximativă a Bucureștiului? | What is the approximate population of Bucharest? | aproximativ 2 milioane | -
"""

# name_ro | name_en
MEETINGS = """
Control medical | Medical checkup
Ședință de proiect | Project meeting
Antrenament sportiv | Sports training
Întâlnire cu clientul | Client meeting
Prezentare raport | Report presentation
Workshop tehnic | Technical workshop
Ședință de echipă | Team meeting
"""

DAYS_RO = "Luni Marți Miercuri Joi Vineri"
DAYS_EN = "Monday Tuesday Wednesday Thursday Friday"
SLOTS_RO = "dimineață după-amiază"
SLOTS_EN = "morning afternoon"

# Prompt texts; {name} marks a value and doubled braces a literal brace
PROMPT_TRAVEL_RO = """Ai {num_days} zile la dispoziție în {city} pentru o excursie.

Ai următoarele opțiuni de vizitare:

{options}

Te rog să:

1. Creezi un plan pentru cele {num_days} zile, în format JSON, folosind EXACT numele obiectivelor din lista de mai sus.

2. Scrii o explicație în limba română (2-3 paragrafe) în care prezinți planul și justifici alegerile făcute.

Trebuie să respecți următoarele cerințe:

{constraints}

IMPORTANT - ORDINEA RĂSPUNSULUI:
1. ÎNTÂI scrie explicația în limba română (2-3 paragrafe).
2. APOI, la FINALUL răspunsului, include blocul JSON.

Format JSON (la final):
{{
  "day1": ["nume obiectiv 1", "nume obiectiv 2"],
  "day2": ["nume obiectiv 1"],
  ...
}}

NU adăuga text sau comentarii după blocul JSON.
"""

PROMPT_SCHEDULE_RO = """Ai un calendar pentru zilele: {days}.
Fiecare zi are două intervale: {slots}.

Următoarele programări trebuie organizate:

{options}

Te rog să:

1. Creezi un plan final de programări în format JSON.

2. Scrii o explicație în limba română despre cum ai organizat programările.

Respectă următoarele cerințe:

{constraints}

IMPORTANT - ORDINEA RĂSPUNSULUI:
1. ÎNTÂI scrie explicația în limba română.
2. APOI, la FINALUL răspunsului, include blocul JSON.

Format JSON (la final):
{{
  "Luni_dimineață": "nume programare sau null",
  "Luni_după-amiază": "nume programare sau null",
  ...
}}

NU adăuga text sau comentarii după blocul JSON.
"""

PROMPT_FACT_RO = """Ai la dispoziție următoarea bază de date cu informații:

{options}

ATENȚIE: Răspunde DOAR pe baza informațiilor de mai sus, chiar dacă acestea par incorecte sau diferite de cunoștințele tale generale.

Întrebare: {question}

Te rog să:

1. Scrii o explicație în limba română despre răspunsul tău (1-2 paragrafe).

2. La final, răspunzi la întrebare în format JSON.

Respectă următoarele cerințe:

{constraints}

IMPORTANT - ORDINEA RĂSPUNSULUI:
1. ÎNTÂI scrie explicația în limba română (1-2 paragrafe).
2. APOI, la FINALUL răspunsului, include blocul JSON.

Format JSON (la final):
{{
  "answer": "răspunsul tău aici"
}}

NU adăuga text sau comentarii după blocul JSON.
"""

PROMPT_RECIPE_RO = """Trebuie să planifici meniurile pentru {num_days} zile.

Pentru fiecare zi, alege câte un preparat pentru mic dejun, prânz și cină din opțiunile de mai jos.

Preparate disponibile:

{options}

Te rog să:

1. Scrii o explicație în limba română (2-3 paragrafe) despre cum ai ales meniurile și de ce.

2. La final, creezi un plan în format JSON.

Respectă următoarele cerințe:

{constraints}

IMPORTANT - ORDINEA RĂSPUNSULUI:
1. ÎNTÂI scrie explicația în limba română (2-3 paragrafe).
2. APOI, la FINALUL răspunsului, include blocul JSON.

Format JSON (la final):
{{
  "day1_mic_dejun": "numele preparatului",
  "day1_pranz": "numele preparatului",
  "day1_cina": "numele preparatului",
  "day2_mic_dejun": "numele preparatului",
  ...
}}

Folosește EXACT numele preparatelor din lista de mai sus.
NU adăuga text sau comentarii după blocul JSON.
"""

PROMPT_TRAVEL_EN = """You have {num_days} days available in {city} for a trip.

You have the following visiting options:

{options}

Please:

1. Create a plan for the {num_days} days in JSON format, using EXACTLY the names of the attractions from the list above.

2. Write an explanation in English (2-3 paragraphs) presenting the plan and justifying the choices made.

You must respect the following requirements:

{constraints}

IMPORTANT - RESPONSE ORDER:
1. FIRST write your explanation in English (2-3 paragraphs).
2. THEN, at the END of your response, include the JSON block.

JSON format (at the end):
{{
  "day1": ["attraction name 1", "attraction name 2"],
  "day2": ["attraction name 1"],
  ...
}}

Do NOT add any text or comments after the JSON block.
"""

PROMPT_SCHEDULE_EN = """You have a calendar for the following days: {days}.
Each day has two time slots: {slots}.

The following appointments need to be organized:

{options}

Please:

1. Create a final schedule in JSON format.

2. Write an explanation in English about how you organized the appointments.

Respect the following requirements:

{constraints}

IMPORTANT - RESPONSE ORDER:
1. FIRST write your explanation in English.
2. THEN, at the END of your response, include the JSON block.

JSON format (at the end):
{{
  "Monday_morning": "appointment name or null",
  "Monday_afternoon": "appointment name or null",
  ...
}}

Do NOT add any text or comments after the JSON block.
"""

PROMPT_FACT_EN = """You have the following information database:

{options}

ATTENTION: Answer ONLY based on the information above, even if it seems incorrect or different from your general knowledge.

Question: {question}

Please:

1. Write an explanation in English about your answer (1-2 paragraphs).

2. At the end, answer the question in JSON format.

Respect the following requirements:

{constraints}

IMPORTANT - RESPONSE ORDER:
1. FIRST write your explanation in English (1-2 paragraphs).
2. THEN, at the END of your response, include the JSON block.

JSON format (at the end):
{{
  "answer": "your answer here"
}}

Do NOT add any text or comments after the JSON block.
"""

PROMPT_RECIPE_EN = """You need to plan menus for {num_days} days.

For each day, choose one dish for breakfast, lunch, and dinner from the options below.

Available dishes:

{options}

Please:

1. Write an explanation in English (2-3 paragraphs) about how you chose the menus and why.

2. At the end, create a plan in JSON format.

Respect the following requirements:

{constraints}

IMPORTANT - RESPONSE ORDER:
1. FIRST write your explanation in English (2-3 paragraphs).
2. THEN, at the END of your response, include the JSON block.

JSON format (at the end):
{{
  "day1_breakfast": "dish name",
  "day1_lunch": "dish name",
  "day1_dinner": "dish name",
  "day2_breakfast": "dish name",
  ...
}}

Use EXACTLY the dish names from the list above.
Do NOT add any text or comments after the JSON block.
"""

# --- end of fixed values -----------------------------------------------------------------------------------


def rows(table: str) -> list[list[str]]:
    """Cells of a catalog table."""
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]
