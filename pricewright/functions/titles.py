"""Attributes of product titles: category, model, product line, role towards a host device, variant attributes.

Everything is a function of columns, computed once per title (see features()); pairs of titles are compared in operators/match_score.py. Rules are tables of
(value, pattern), tried in order. The patterns are written for a dialect whose word borders know ASCII only; rx() says the same in Java's.
"""

from __future__ import annotations

import functools
import re
from re import _parser as syntax

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import text as t
from .text import let

#: Java's \w is ASCII whatever the case flags say; a class of ranges would be folded character by character, at every place of a text.
_BORDER = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
#: A border before a letter or digit that must follow can only be the beginning of a word.
_BEGINS, _BEFORE_WORD = r"(?<!\w)(?=\w)", re.compile(r"\\b(?=[A-Za-z0-9](?![?*{]))")
PLACEHOLDER = "Товар"

#: Variant attributes, in the order in which they are looked for.
CONNECTORS = (
    ("usb-c", r"\b(?:usb[\s\-]?c|type[\s\-]?c|тайп[\s\-]?си|typec)\b"), ("lightning", r"\b(?:lightning|лайтнинг)\b"),
    ("3.5mm", r"(?:3[\.,]5\s*(?:mm|мм)|jack\s*3[\.,]5|mini[\s\-]?jack)"), ("usb-a", r"\b(?:usb[\s\-]?a|type[\s\-]?a)\b"),
)
CONDITIONS = (
    ("refurbished", r"(?:refurbished|recon|восстановлен[а-яёa-z]*)"), ("cpo", r"\b(?:cpo|certified\s+pre[\s\-]?owned)\b"), ("used", r"(?:б\s*\/\s*у|бу|used|pre[\s\-]?owned)"),
    ("new", r"(?:new|нов(?:ый|ая|ое|ые))"),
)
AUTHENTICITY = (
    ("original", r"(?:original|оригинал[а-яёa-z]*|originale)"), ("oem", r"\b(?:oem)\b"), ("compatible", r"(?:compatible|совместим[а-яёa-z]*|compatible[\s\-]?copy)"), ("analog", r"(?:analog|аналог[а-яёa-z]*)"),
    ("replica", r"муляж|имитац[а-яёa-z]*|реквизит|нефункционал[а-яёa-z]*|не\s*рабоч[а-яёa-z]*|игрушк[а-яёa-z]*|\bdummy\b|\bmockup\b|display\s*model|\bprops?\b"),
    ("replica", r"(?:replica|реплик[а-яёa-z]*|копия)"),
)
REGIONS = (
    ("global", r"(?:global|глобал[а-яёa-z]*)"), ("ru", r"(?:\bru\b|ростест|рст|\beac\b)"), ("eu", r"(?:eu|европ[а-яёa-z]*)"), ("us", r"\b(?:us|usa)\b"), ("in", r"\b(?:in|india|индия)\b"),
    ("esim_only", r"\b(?:e[\s\-]?sim(?:\s*only)?)\b"), ("sim_physical", r"\b(?:nano[\s\-]?sim|physical\s*sim|физическ[а-яёa-z]*\s*sim)\b"),
)
EDITIONS = (("disc", r"\b(?:disc|дисков\w*|с\s+дисковод\w*)\b"), ("digital", r"\b(?:digital|без\s+дисковод\w*)\b"), ("kit", r"\b(?:kit|комплект\w*|bundle)\b"), ("body", r"\b(?:body|body\s*only|тушка)\b"))
SCENTS = (
    ("menthol", r"ментол|menthol"), ("citrus", r"цитрус|citrus|цитрусовая\s+свежест"), ("classic", r"классик|classic|классическ"), ("fresh", r"свежест|\bfresh\b"), ("apple", r"яблок|\bapple\b"),
    ("lavender", r"лаванд|lavender"), ("coconut", r"кокос|coconut"), ("aloe", r"алoe|алое|aloe"),
)
MATERIALS = {
    "cotton": "cotton", "хлопок": "cotton", "polyester": "polyester", "полиэстер": "polyester", "leather": "leather", "кожа": "leather", "экокожа": "leather", "suede": "suede", "замша": "suede", "wool": "wool",
    "шерсть": "wool", "nylon": "nylon", "нейлон": "nylon",
}
#: Genders, and the colour words that are looked for first.
GENDERS = (
    ("male", r"мужск|для\s+муж|men'?s?\b|male\b"), ("female", r"женск|для\s+жен|women'?s?\b|female\b|lady\b"), ("unisex", r"унисекс|unisex"), ("kids", r"детск|для\s+дет|kids?\b|child"),
)
COLOR_WORD = (
    r"\b(space\s*black|jet\s*black|midnight|graphite|obsidian|porcelain|indigo|hazel|starlight|lemongrass|светло-?ж[её]лт\w*|ж[её]лт(?:ый|ая|ое)?|ч[её]рн(?:ый|ая|ое)?|бел(?:ый|ая|ое)?|син(?:ий|яя|ее)?|"
    r"серебрист(?:ый|ая|ое)?|сер(?:ый|ая|ое)?|зел[её]н(?:ый|ая|ое)?|красн(?:ый|ая|ое)?|золот(?:ой|ая|ое)?|фиолетов(?:ый|ая|ое)?|розов(?:ый|ая|ое)?|бежев(?:ый|ая|ое)?|коричнев(?:ый|ая|ое)?|"
    r"black|white|blue|silver|grey|gray|green|red|gold|purple|pink|beige|brown|yellow)\b"
)
#: Model names, the more special first.
MODELS = (
    r"\bdual\s*sense\b", r"\bdualshock\b", r"\biphone\s*(se\s*(?:\d{4}|\(\d{4}\))?|\d{1,2}\s*(?:pro\s*max|pro|plus|mini)?)\b",
    r"\bgalaxy\s*((?:s|a|m|z|f|note)\s*\d{1,2}(?:\s*(?:ultra|plus|fe|\+))?|z\s*fold\s*\d|z\s*flip\s*\d)\b", r"\bmacbook\s*(?:air|pro)?\s*(?:m[1-4](?:\s*pro)?|\d{4})?\b",
    r"\bipad\s*(?:pro|air|mini)?\s*\d{1,2}(?:\s*(?:pro|air|mini))?\b", r"\bapple\s*watch\s*(?:series\s*)?\d{1,2}(?:\s*(?:ultra|se))?\b", r"\bairpods\s*max\b",
    r"\bairpods\s*pro\s*(?:\d(?:\s*(?:го|го поколения))?|\s*(?:2|3))?\b", r"\bairpods\s*(?:\d|anc)\b", r"\bairpods\b",
    r"\b(?:redmi|xiaomi)\s+buds\s*\d{1,2}(?:\s*(?:pro|live|fe|plus|\+|titan|play|active))?\b", r"\b(?:redmi|xiaomi).{0,40}?\bbuds\s*\d{1,2}(?:\s*(?:pro|live|fe|plus|\+|titan|play|active))?\b",
    r"\b(?:samsung\s+)?galaxy\s+buds\s*\d{1,2}(?:\s*(?:pro|live|fe|plus|\+|2))?\b", r"\bbuds\s*\d{1,2}(?:\s*(?:pro|live|fe|plus|\+|titan|play|active))?\b", r"\bjbl\s+tune\s*\d{3}\b",
    r"\bjbl\s+(?:live|wave|quantum)\s*\d{2,3}\b", r"\bwh[-\s]?1000xm\d\b", r"\bamazfit\s+(?:gtr|bip|balance|cheetah|t-rex)\s*\d{1,2}\b", r"\bxiaomi\s+smart\s+band\s*\d{1,2}\b", r"\bmi\s+band\s*\d{1,2}\b",
    r"\broborock\s+s\d{1,2}(?:\s*pro)?(?:\s*ultra)?\b", r"\bdreame\s+[a-z]?\d{2,4}\b", r"\bredmond\s+rmc[-\s]?[a-z]?\d{3,5}[a-z]?\b", r"\bpolaris\s+[a-z]{2,5}[\s-]?\d{3,5}\b",
    r"\bsamsung\s+ww\d{2}[a-z]?\d{3,5}[a-z]?\b", r"\boptimum\s+nutrition\s+gold\s+standard\b", r"\bgoogle\s+pixel\s*\d{1,2}[a-z]?(?:\s*(?:pro|a|xl))?\b", r"\bpixel\s*\d{1,2}[a-z]?(?:\s*(?:pro|a|xl))?\b",
    r"\b(?:redmi|poco|xiaomi)\s*(?:note\s*)?\d{1,2}(?:\s*(?:pro|ultra|\+|t|s|c))?\b", r"\brealme\s*(?:\d{1,2}(?:\s*5g)?(?:\s*pro)?|note\s*\d+)\b", r"\bredmi\s+\d{1,2}\b", r"\bpoco\s*[a-z]\d{1,2}(?:\s*pro)?\b",
    r"\b(?:geforce\s*)?(?:rtx|gtx)\s*\d{3,4}(?:\s*(?:ti|super|xt))?\b", r"\b(?:radeon\s*)?rx\s*\d{3,4}(?:\s*xt)?\b", r"\b(?:core\s*)?i[3579]-?\d{4,5}[a-z]{0,3}\b", r"\bryzen\s*\d{1,2}\s*\d{4}[a-z]{0,3}\b",
    r"\bplaystation\s*\d\b", r"\binstax\s*mini\s*\d{1,2}\b", r"\binstax\s*(?:mini|wide|square)\b", r"\bxbox\s*series\s*[xs]\b", r"\bnintendo\s*switch(?:\s*(?:oled|lite))?\b", r"\bcanon\s+eos\s*\d{3,4}\s*d?\b",
    r"\beos\s*\d{3,4}\s*d\b", r"\bcanon\s+\d{3,4}\s*d\b", r"\bnikon\s+d\d{3,4}\b", r"\bsony\s+(?:alpha|α)\s*\d{1,2}\b", r"\bfujifilm\s+x-?[st]\d{1,2}\b", r"\b(?:ef|rf)\s*-?\s*\d{1,3}\s*mm\s*f\/?[\d.]+",
    r"\b\d{1,3}\s*mm\s*f\/?[\d.]+\b", r"\bplaystation\s*[45]\b", r"\bps\s*[45]\b", r"\bxbox\s+series\s*[xs]\b", r"\bsteam\s+deck\b", r"\b(?:bosch|makita|metabo|deko|интерскол)\s+[a-z]{2,5}[\s-]?\d{3,5}[a-z]?\b",
    r"\bgsb\s*\d{3,4}\b", r"\b[a-z]{1,4}-[a-z]?\d{3,6}[a-z0-9]*(?:\s*[a-z]-?\d{1,3}[a-z]{1,3})?\b",
)
#: What a title's leading words are without, where no model name is found.
TITLE_NOISE = r"\b(смартфон|телефон|ноутбук|видеокарта|наушники|планшет|фотоаппарат|чехол|зарядка|кабель|чёрный|белый|синий|128|256|512|1024)\b"
_NOT_PART = r"(?!.*(?:аккумулятор|батаре\w*|battery|чехол|сумк\w*\s+для))"
#: Words by which a title is of a category, in the order in which categories are tried. A word that others bar is found first and then looked behind, so that a title is read once.
CATEGORIES = (
    ("memory_cards", r"micro\s*sd(?:xc|hc)?|\bsd\s*xc\b|\bsd\s*card\b|карта\s+памяти|флеш[-\s]?карт|memory\s+card|\bcanvas\s+go\b|\bcanvas\s+select\b"),
    ("accessories", r"\bsoft\s+(?:tpu\s+)?case\b|\bprotective\s+case\b|\bsilicone\s+case\b|\b(?:phone|iphone|galaxy|pixel|xiaomi)?\s*case\b|\b(?:back\s+)?cover\b|\blaptop\s+(?:sleeve|bag|case)\b|\bnotebook\s+(?:sleeve|bag|case)\b|\bsleeve\s+bag\b|"
     r"\btempered\s+glass\b|\bscreen\s+protector\b|\bcharging\s+cable\b|\b(?:usb[-\s]?c|lightning|type[-\s]?c)\s+cable\b|\b(?:wall\s+)?charger\b|\b(?:power\s+)?adapter\b|\bdual\s*sense\b|\bdualshock\b|геймпад|джойстик|беспроводн\w*\s+контроллер|"
     r"контроллер\s+для\s+(?:playstation|xbox|switch|приставк)|(?:аккумулятор|батаре\w*|battery)|(?:чехол|сумк\w*).{0,40}(?:фото|nikon|canon|sony|fujifilm|dslr|\bd\d{3,4}\b)|(?:для\s+(?:фотоаппарат|камеры|nikon|canon)).{0,24}(?:чехол|сумк)|"
     r"(?=чехол|защитн\w*\s+(?:стекл|плёнк|пленк)|плёнк|пленк|кабель\s+(?:usb|type|type-c|lightning)|зарядк|зарядн(?:ое|ый)\s+(?:устрой|блок)|держатель|подставк|"
     r"сумк\w*\s+для\s+(?:ноут|laptop))(?!.*(?:смартфон|ноутбук|laptop|macbook|телевизор|монитор|\bsmartphone\b))|чехол\s+для\s+(?:iphone|galaxy|samsung|xiaomi|redmi|телефон|смартфон|ноут)|(?:стекл|плёнк|пленк).{0,24}(?:iphone|galaxy|samsung|xiaomi)|сумка\s+для\s+ноут|подставк\w*\s+для\s+ноут"),
    ("tvs", r"телевизор|\bsmart\s*tv\b|\bUE\d{2}|\bQN\d{2}|\bOLED\s*(?:TV|телевизор)|\bQLED\b"), ("monitors", r"монитор|\bmonitor\b|\bgaming\s+monitor\b"),
    ("smartphones", r"смартфон|\bsmartphone\b|телефон|\biphone\b|\bphone\b|\bredmi\b|\brealme\b|\bpoco\b|\bgalaxy\s*[as]\d"),
    ("gpus", r"видеокарт|\bgpu\b|графическ(ая|ий)\s*(карт|процессор)|трафарет.{0,24}rtx|наклейк.{0,24}rtx"), ("monoblocks", r"моноблок|all[-\s]?in[-\s]?one|\baio\s*(?:pc|пк)?\b"),
    ("desktops", r"мини[-\s]?пк|mini[-\s]?pc|неттоп|\bnuc\b|системн(ый|ого)\s*блок|игровой\s+компьютер|\bdesktop\b|пк\s+игровой|игровой\s+пк\b"), ("laptops", r"ноутбук|\blaptop\b|\bmacbook\b|\bnotebook\b|\bultrabook\b"),
    ("pc_components", r"оперативн[а-яё]*\s+память|модуль\s+памяти|материнск[а-яё]*\s+плат|\bmotherboard\b|блок\s+питания(?:\s+для\s+(?:пк|компьютер))?|\bpsu\b|накопител[а-яё]+\s+ssd|ssd\s+накопител|процессор\s+(?:intel|amd)|\bcpu\s+(?:intel|amd)|"
     r"(?:^|[\s])(?:озу|dimm)(?:\s|$)"),
    ("headphones", r"наушник|\bheadphones?\b|\bearbuds?\b|\bairpods\b|\bgalaxy\s*buds|\bheadset\b"),
    ("wearables", r"умные\s+часы|фитнес\s*[-\s]?браслет|smart\s*band|\bamazfit\b|\bmi\s*band\b|xiaomi\s+smart\s+band|\bgalaxy\s*watch\b|apple\s+watch|смарт\s*[-\s]?часы"),
    ("lenses", r"\bобъектив\b|\blens\b|\b(?:ef|rf|e)\s*-?\s*\d{1,3}\s*mm\b|\b\d{1,3}\s*[-–]\s*\d{2,3}\s*mm\s*f\/?\d"),
    ("cameras", rf"(?=фотоаппарат|зеркал|беззеркал|\bdslr\b|\bmirrorless\b|\bcanon\s+eos\b|\bnikon\s+d\d|\bsony\s+(?:alpha|α)\s*\d|\bfujifilm\s+x-?[st]\d){_NOT_PART}"),
    ("consoles", r"игровая\s+приставк|\bplaystation\s*\d\b|\bps\s*[45]\b|\bxbox\s+series\b|\bnintendo\s+switch\b|\bsteam\s+deck\b"),
    ("networking", r"точка\s+доступа|\baccess\s*point\b|маршрутизатор|\bроутер\b|\brouter\b|\bmesh\s*(?:wifi|wi-?fi|system|система)?\b|\bwi-?fi\s*[67]\b|\bax\d{3,4}\b|\bap\d{3,4}\b|outdoor\s+ax|\b(?:cudy|tp-?link|keenetic|mikrotik|ubiquiti|asus\s+rt-)\b"),
    ("power_tools", r"дрель|шурупов|перфоратор|болгарк|лобзик|шлифмашин|садов|газонокосил|культиватор|barbecue|барбекю|гриль|\bgsb\s*\d|\bdcd\d|\b(?:bosch|makita|metabo|deko|интерскол)\s+[a-z]{2,5}[\s-]?\d{3,5}"),
    ("appliances", r"стиральная\s+машин|робот[-\s]?пылесос|робот\s+пылесос|\broborock\b|\bdreame\b|мультивар|холодильник|пылесос|микроволнов|посудомо|кондиционер(?!\s+для\s+бель)|вытяжк|варочн|духов|чайник|фен(?!\s+для)|зубн(?:ая|ой)\s+щ[её]тк|"
     r"электрическ\w*\s+щ[её]тк|\boral[\s-]?b\b|бытов(?:ая|ой)\s+техник"),
    ("home_textile", r"постельн|комплект\s+постель|простын|пододеяльник|наволочк|полотенц|плед|покрывал|одеяло|подушк(?!\s+декор)"),
    ("home_goods", r"комод|стеллаж|\bтумб|шкаф|кровать|диван|письменн\w*\s+стол|журнальн\w*\s+стол|органайзер|контейнер\s+для\s+хранен|кастрюл|сковород|посуда|тарелк|чаш(?:ка|ки)|стакан|ваза|декор|сервиз"),
    ("kids", r"детск(?:ая|ие|ий|ое|ого|ому)|для\s+дет|для\s+малыш|подгузник|пампер|\bkids?\b|новорожд"),
    ("sports", r"протеин|спорт(?:ив)?(?:ное\s+)?питан|optimum\s+nutrition|гантел|штанга|коврик\s+для\s+(?:йог|фитнес)|спортивн(?:ая|ое|ый|ые)\s+(?:одежд|костюм|футболк)|фитнес"),
    ("shoes", r"кроссовк|ботинк|туфл|сапог|\bsneakers?\b|\bshoes?\b|обувь|кеды|лоферы|мокасин"),
    ("apparel", r"футболк|лонгслив|худи|свитшот|куртк|джинс|платье|платья|рубашк|брюк|штаны|костюм|спортивн(?:ая|ый|ое)\s+костюм|леггинс|кардиган|\bt[- ]?shirt\b|\bhoodie\b|\bjacket\b|одежда"),
    ("detergents", r"порошок|гель\s+для\s+стирк|средство\s+для\s+(?:стирк|мытья|уборк)|ополаскивател|кондиционер\s+для\s+бель|deterg|\bfairy\b|\bpersil\b|\bariel\b|\bdomestos\b"),
    ("cosmetics", r"шампунь|тушь|помад|тонал|сыворотк|косметик|парфюм|духи|маск[аи]\s+для\s+(?:лица|волос)|крем\s+для\s+(?:лица|рук|тела|ног)|\bl(?:'|’)or[eé]al\b|loreal|\bmaybelline\b"),
    ("grocery", r"крабов[а-яё]*\s+палоч|рыбн[а-яё]*\s+базар|колбас|сосис[кк]|йогурт|творог|молоко(?!\s+для\s+(?:кожи|ванн))|\bсыр\b|батончик|чипсы|шоколад(?!\s+цвет)|печенье|макарон|консерв|завтрак\s+сухой|хлопья\s+(?:кукур|овс)|газировк|"
     r"минеральн[а-яё]*\s+вод|\bsnack\b|\bgrocery\b"),
    ("pet_food", r"корм\s+для|сухой\s+корм|влажный\s+корм|для\s+(?:кош|соб|щен|котят)|наполнител|кошач(?:ий|ья)\s+туалет|\bwet\s+food\b|\bdry\s+food\b|\bwhiskas\b|\broyal\s+canin\b|\bpedigree\b"),
)

#: Edges of words of either alphabet, and the rule pack of roles towards a host device.
_L, _R = r'(?:^|[\s,.;:«"(«\-–—])', r'(?=$|[\s,.;:»")\-–—])'
ROLES = (
    ("accessory", "контроллер", rf"{_L}(?:dual\s*sense|dualshock|геймпад|джойстик|контроллер|controller|gamepad){_R}"),
    ("accessory", "чехол", rf"{_L}(?:чехол|case|защитн\w*\s+(?:стекл|плёнк|пленк)|плёнк\w*|пленк\w*){_R}"),
    ("consumable", "картридж", rf"{_L}(?:картридж|тонер|чернил\w*|cartridge|toner){_R}"), ("part", "фильтр", rf"{_L}(?:фильтр|hepa|filter){_R}"), ("consumable", "насадка", rf"{_L}(?:насадк\w*|brush\s*head){_R}"),
    ("part", "аккумулятор", rf"{_L}(?:аккумулятор|батаре\w*|battery){_R}"), ("supply", "капсулы", rf"{_L}(?:капсул\w*|capsules?){_R}"), ("supply", "корм", rf"{_L}(?:корм\s+для|wet\s+food|dry\s+food)"),
    ("consumable", "патчи", rf"{_L}(?:патч\w*|patches?){_R}"), ("accessory", None, rf"{_L}(?:кабель|зарядк\w*|зарядн\w*|cable|charger){_R}"),
)
HOSTS = (
    ("console", rf"{_L}(?:playstation|ps\s*[45]|xbox(?:\s+series)?|nintendo\s+switch|steam\s+deck|игровая\s+приставк\w*|приставк\w*){_R}", rf"{_L}((?:playstation\s*[45]|ps\s*[45]|xbox\s+series\s*[xs]?|nintendo\s+switch(?:\s*(?:oled|lite))?|steam\s+deck)){_R}"),
    ("phone", rf"{_L}(?:iphone|galaxy\s*[samz]\d|смартфон|телефон|redmi\s*(?:note\s*)?\d|xiaomi\s+\d)", rf"{_L}((?:iphone\s*\d{{1,2}}(?:\s*(?:pro\s*max|pro|plus|mini))?|galaxy\s*[samz]\s*\d{{1,2}}(?:\s*(?:ultra|plus|fe))?|redmi\s*(?:note\s*)?\d{{1,2}})){_R}"),
    ("printer", rf"{_L}(?:принтер|мфу|laserjet|deskjet|officejet|epson|brother|printer){_R}", rf"{_L}((?:laserjet|deskjet|officejet|принтер)[\w\s-]{{0,24}})"),
    ("vacuum", rf"{_L}(?:пылесос|vacuum|dyson\s*v\d+|roborock|dreame){_R}", rf"{_L}((?:dyson\s*v\d+\w*|roborock\s*s?\d+\w*|dreame\s*\w+)){_R}"),
    ("toothbrush", rf"{_L}(?:oral[\s-]?b|зубн\w*\s+щ[её]тк\w*|electric\s+toothbrush)", rf"{_L}((?:oral[\s-]?b[\w\s-]{{0,16}}|зубн\w*\s+щ[её]тк\w*))"),
    ("power_tool", rf"{_L}(?:makita|bosch|дрель|шурупов\w*|перфоратор|болгарк\w*){_R}", rf"{_L}((?:makita|bosch|metabo)[\w\s-]{{0,20}}){_R}"),
    ("coffee", rf"{_L}(?:nespresso|кофемашин\w*|кофеварк\w*|coffee\s*machine|espresso){_R}", rf"{_L}((?:nespresso|кофемашин\w*|кофеварк\w*)){_R}"),
    ("pet", rf"{_L}(?:кошк\w*|котят\w*|собак\w*|щенк\w*|cat|dog|kitten|puppy){_R}", None),
)
HINTS = (
    ("DualSense", "accessory", "console", "контроллер", r"\bdual\s*sense\b"), ("DualShock", "accessory", "console", "контроллер", r"\bdualshock\b"),
    ("Nespresso", "supply", "coffee", "капсулы", r"(?:капсул\w*.{0,48}nespresso|nespresso.{0,48}капсул\w*)"),
)
#: Words that say nothing of a product, roles that depend on a host and from when a role is sure, makers of hosts, and how texts speak of hosts, bundles and parts.
MARKETING = (r"(?:беспроводн\w*|wireless)", r"(?:оригинальн\w*|original|оригинал)", r"(?:новый|новая|новое|new)", r"(?:белый|черный|чёрный|синий|красный|серый|white|black|blue|red|gray|grey)")
DEPENDENT, SURE = ("accessory", "consumable", "part", "supply"), 0.55
HOST_BRANDS = ("sony", "hp", "dyson", "nespresso", "makita", "bosch", "apple", "samsung", "oral-b", "oralb", "canon", "epson", "xiaomi", "royal canin")
FOR_HOST = r"(?:^|[\s,.;:(])(?:для|for|под|совместим(?:ый|ая|ое|ые)?\s+с|compatible\s+with)\s+"
IN_BUNDLE = r"(?:в\s+комплекте|комплектаци\w*|включ[её]н\w*|вместе\s+с|дополнительно|\+\s*)"
HOST_LEAD = r"(?:игровая\s+приставк\w*|приставк\w*|смартфон\w*|телефон\w*|принтер\w*|мфу|пылесос\w*|кофемашин\w*|toothbrush|зубн\w*\s+щ[её]тк)"
DEPENDENT_LEAD = r"^(?:беспроводн\w*\s+|оригинальн\w*\s+|новый\s+|новая\s+)?(?:dual\s*sense|dualshock|геймпад\w*|джойстик\w*|контроллер\w*|controller|gamepad|чехол\w*|case|картридж\w*|фильтр\w*|насадк\w*|капсул\w*|плёнк\w*|пленк\w*)"
ENTITY_NOISE = r"\b(?:беспроводн\w*|wireless|оригинальн\w*|original|белый|черный|чёрный|синий|white|black)\b"


def rx(pattern: str) -> str:
    """The pattern in Java's dialect: any case of any alphabet, word borders of ASCII words."""
    return "(?iu)" + _BEFORE_WORD.sub(lambda _: _BEGINS, pattern).replace(r"\b", _BORDER)


#: Letters that some case of a pattern's letter folds to but lower() leaves, and what they fold to.
_FOLDED = "ſıİᲀᲁᲂᲃᲄᲅᲆᲇᲈ", "siiвдосттъѣꙋ"


def folded(x: Column) -> Column:
    """x for may_have(). Few texts have such letters, and replacing goes letter by letter."""
    return let(x, lambda v: F.lower(F.when(v.rlike(f"[{_FOLDED[0]}]"), F.translate(v, *_FOLDED)).otherwise(v)))


@functools.cache
def needed(pattern: str) -> frozenset[str]:
    """Runs of letters and digits, in lower case, of which every text that matches the pattern has one; none where the pattern asks for none of two characters."""

    def shortest(words: set[str]) -> int:
        return min(map(len, words), default=0)

    def of(nodes) -> set[str]:
        best, run = set(), ""
        for kind, value in [*nodes, (None, None)]:
            if kind is syntax.LITERAL and chr(value).isalnum():
                run += chr(value).lower()
                continue
            found, run = [{run}, set()], ""
            if kind is syntax.BRANCH:
                sets = [of(branch) for branch in value[1]]
                found[1] = set().union(*sets) if all(sets) else set()
            elif kind is syntax.SUBPATTERN:
                found[1] = of(value[3])
            elif kind in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[0] > 0:
                found[1] = of(value[2])
            elif kind is syntax.ASSERT and value[0] > 0:
                found[1] = of(value[1])
            best = max(best, *found, key=shortest)
        return best if shortest(best) > 1 else set()

    return frozenset(of(syntax.parse(pattern)))


def may_have(low: Column, pattern: str) -> Column:
    """Whether a folded() text has what a match of the pattern needs: most texts lack it, and aren't searched then."""
    words = sorted(needed(pattern))
    return functools.reduce(lambda a, b: a | b, [low.contains(w) for w in words]) if words else F.lit(True)


def has(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(rx(pattern)), F.lit(False))


def part(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return t.matched(x, rx(pattern), group)


def first_rule(x: Column, rules, low: Column | None = None) -> Column:
    """Value of the first rule (value, pattern) that holds, or null. low: folded(x), where it is known."""
    return let(F.struct(x.alias("x"), (folded(x) if low is None else low).alias("low")), lambda v: F.coalesce(*[F.when(may_have(v["low"], pattern) & v["x"].rlike(rx(pattern)), value) for value, pattern in rules]))


def spaced(x: Column) -> Column:
    """No-break spaces as spaces, runs of white space as one, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(x, " ", " "), r"\s+", " "))


def _number(x: Column, pattern: str) -> Column:
    return F.translate(part(x, pattern, 1), ",", ".").cast("double")


def material_of(x: Column) -> Column:
    return let(F.lower(x), lambda low: F.coalesce(*[F.when(low.contains(word), F.lit(name)) for word, name in MATERIALS.items()]))


def scent_of(x: Column) -> Column:
    return first_rule(x, SCENTS)


def connector_of(x: Column) -> Column:
    return first_rule(F.translate(x, " ", " "), CONNECTORS)


def condition_of(x: Column) -> Column:
    return first_rule(F.translate(x, " ", " "), CONDITIONS)


def authenticity_of(x: Column) -> Column:
    return first_rule(F.translate(x, " ", " "), AUTHENTICITY)


def region_of(x: Column) -> Column:
    return first_rule(F.translate(x, " ", " "), REGIONS)


def edition_of(x: Column) -> Column:
    return first_rule(F.translate(x, " ", " "), EDITIONS)


def category_of(x: Column) -> Column:
    """The first category of the table whose words the text has, else generic."""
    return F.coalesce(first_rule(F.trim(F.regexp_replace(x, r"\s+", " ")), CATEGORIES), F.lit("generic"))


#: How titles give weights, sizes, series and part numbers.
KILO, GRAM, CYRILLIC_GRAM = r"(?:кг|kg)\b", r"(\d+(?:\.\d+)?)\s*(?:г|g|гр|грамм(?:а|ов)?)\b", r"(?:грамм(?:а|ов)?|гр\.?|г(?![a-zа-яё]))\b"
SIZE_LETTERS, SIZE_NUMBER = r"\b(xxs|xs|s|m|l|xl|xxl|xxxl|2xl|3xl)\b", r"\b(?:размер|size)?\s*(\d{2}(?:[,.]\d)?)\b"
SIZE_SAID, SIZE_ALONE = r"(?:размер|size)[:\s]*([xxsml]{1,4}|\d{2}(?:[,.]\d)?)", r"[,\s]([SML]|XS|XXL|XL|XXS)(?:[,\s]|$)"
SERIES_SAID, SERIES_KNOWN = r"(?:серия|линейка|series)\s*[:\-]?\s*([A-Za-zА-Яа-яЁё0-9][\wА-Яа-яЁё\- ]{1,40})", r"\b((?:Persil|Ariel|Fairy|Domestos|Whiskas|Royal Canin|L(?:'|')?Or[eé]al|Maybelline|JBL|Roborock|Redmond)[\w\-]*)\b"
NUMBER_SAID, NUMBER_LIKE = r"(?:артикул|mpn|p\/n|part\s*number)\s*[:\-]?\s*([A-Z0-9][\w\-]{3,24})", r"([A-Z]{2,}\d{3,}[A-Z0-9\-]*)"


def weight_g(x: Column) -> Column:
    """Kilograms times 1000, else grams below 100 000. A Cyrillic unit counts only before an ASCII letter or digit, as in the rules that this follows."""
    number, unit = r"(\d+(?:[.,]\d+)?)\s*", F.translate(x, " ", " ")
    grams = lambda u: let(_number(F.regexp_replace(u, r"^([^,]*),", "$1."), GRAM), lambda gram: F.when((gram > 0) & (gram < 100_000), F.floor(gram + 0.5)))
    told = lambda u: let(_number(u, number + KILO), lambda kilo: F.when(kilo > 0, F.floor(kilo * 1000 + 0.5)).when(kilo.isNull() & ~has(u, number + CYRILLIC_GRAM), grams(u)))
    return let(unit, told)


def _size(x: Column) -> Column:
    number = let(_number(x, SIZE_NUMBER), lambda european: F.when(european.between(20, 60), F.regexp_replace(F.format_string("%.1f", european), r"\.0$", "")))
    return F.coalesce(F.replace(F.replace(F.upper(part(x, SIZE_LETTERS, 1)), F.lit("2XL"), F.lit("XXL")), F.lit("3XL"), F.lit("XXXL")), number)


def size_of(x: Column) -> Column:
    """Letters (XS, M, XXL) or a European number from 20 to 60: what follows 'size', else a letter that stands alone, else any."""
    return let(F.translate(x, " ", " "), lambda v: let(F.coalesce(part(v, SIZE_SAID, 1), part(v, SIZE_ALONE, 1), v), _size))


def color_of(x: Column) -> Column:
    """Family of the first colour word, else of the first known word that the text contains in any place."""
    inside = lambda low: F.coalesce(*[F.when(low.contains(w), F.lit(f)) for f, words in t.COLORS.items() for w in words])
    return let(F.lower(x), lambda low: let(part(low, COLOR_WORD, 1), lambda word: F.when(word.isNotNull(), F.coalesce(t.color(word), word)).otherwise(inside(low))))


def series_of(x: Column) -> Column:
    said = part(x, SERIES_SAID, 1)
    known = part(x, SERIES_KNOWN, 1)
    return F.substring(F.trim(F.coalesce(said, known)), 1, 40)


def part_number_of(x: Column) -> Column:
    said = part(x, NUMBER_SAID, 1)
    return F.coalesce(said, F.nullif(F.regexp_extract(x, _BORDER + NUMBER_LIKE + _BORDER, 1), F.lit("")))


#: Forms of memory in titles, in the order in which they are tried: RAM and ROM, or ROM alone (one group), and whether ROM is in terabytes.
_NO_LETTER = r"(?![a-zа-яё])"
MEMORY_FORMS = (
    (rf"(\d{{1,2}})\s*\+\s*(\d(?:[.,]\d)?)\s*(?:тб|tb){_NO_LETTER}", 2, True), (r"(\d{1,2})\s*(?:gb|гб)\s*\/\s*(\d{2,4})\s*(?:gb|гб)", 2, False), (r"\b(\d{1,2})\s*\+\s*(\d{2,4})\b", 2, False),
    (r"\b(\d{1,2})\s*\/\s*(\d{2,4})\s*(?:gb|гб|гб\.?)?\b", 2, False), (r"\b(\d{1,2})\s*(?:gb|гб)\s*\+\s*(\d{2,4})\s*(?:gb|гб)\b", 2, False), (rf"(\d(?:[.,]\d)?)\s*(?:тб|tb){_NO_LETTER}", 1, True), (r"\b(\d{2,4})\s*(?:gb|гб)\b", 1, False),
)


def storage_variant(x: Column) -> Column:
    """Memory as the variant rules read it (MEMORY_FORMS): RAM+ROM, else ROM; terabytes count 1024."""
    def told(v: Column, pattern: str, groups: int, tera: bool) -> Column:
        whole = lambda rom: F.floor(F.translate(rom, ",", ".").cast("double") * 1024 + 0.5).cast("string") if tera else rom
        size = whole(part(v, pattern, groups))
        return F.when(v.rlike(rx(pattern)), F.concat(part(v, pattern, 1), F.lit("+"), size) if groups == 2 else F.concat(size, F.lit("gb")))

    # all forms have a digit
    return let(x, lambda v: F.when(v.rlike("[0-9]"), F.coalesce(*[told(v, *form) for form in MEMORY_FORMS])))


#: Product lines and their generations as titles name them.
LINES = {
    "buds": r"\bbuds\s*(\d{1,2})\b",
    "redmi": r"\b(?:redmi|xiaomi)\b",
    "galaxy": r"\b(?:galaxy|samsung)\b",
    "airpods": r"\bairpods\s*(\d)\b",
    "iphone": r"\biphone\s*(\d{1,2})\s*(pro\s*max|promax|pro|plus|mini)?\b",
    "pixel": r"\b(?:google\s+)?pixel\s*(\d{1,2}[a-z]?)(?:\s*(pro|xl))?\b",
    "sony": r"\bwh[-\s]?1000xm(\d)\b",
    "canvas": r"\bcanvas\s*(go!?|select|react|endurance)\s*(plus)?\b",
    "card": r"\b(?:micro\s*sd|карта\s+памяти|memory\s+card)\b",
    "card_gen": r"\bgen\s*([0-9]{1,2}[a-z]?)\b",
    "dyson": r"\bdyson\s+(supersonic|airwrap)\b",
    "dyson_gen": r"\bhd\s*([0-9]{2})\b",
    "tool": r"\b([a-z]{2,5})\s*(\d{1,3}v(?:-\d{1,3})?)\b",
    "robot": r"\b(?:robot|робот|roborock|dreame|vacuum|пылесос)\b",
    "robot_gen": r"\b(s\d{1,2}(?:\s*(?:max|ultra|pro))?)\b",
}


def lineage_of(title: Column) -> Column:
    """struct(lineage, gen, gen_key) of a product line and its generation, or null: the first family that the title is of."""
    kind = "struct<lineage:string,gen:int,gen_key:string>"
    none = F.lit(None).cast("string")

    def line(name: Column, gen: Column, key: Column | None = None) -> Column:
        given = F.struct(name.alias("lineage"), gen.cast("int").alias("gen"), (none if key is None else key).alias("gen_key"), gen.isNotNull().alias("known"))
        return let(given, lambda g: F.when(g["lineage"].isNotNull() & g["known"], F.struct(g["lineage"].alias("lineage"), g["gen"].alias("gen"), g["gen_key"].alias("gen_key")))).cast(kind)

    digits = lambda c: F.nullif(F.regexp_extract(c, r"^\d+", 0), F.lit(""))
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    above = lambda c: F.when(c.cast("int") > 0, c)

    def told(v: Column) -> Column:
        x, low = v["x"], v["low"]
        one = lambda name: F.when(may_have(low, LINES[name]), part(x, LINES[name], 1))
        both = lambda name: F.struct(part(x, LINES[name], 1).alias("first"), part(x, LINES[name], 2).alias("second"))
        two = lambda name, of, needs=None: F.when(may_have(low, LINES[name]) if needs is None else needs, let(both(name), of))
        maker = F.when(has(x, LINES["redmi"]), "buds:redmi").when(has(x, LINES["galaxy"]), "buds:galaxy").otherwise("buds:generic")

        def of_flash(f: Column) -> Column:
            card = f["first"].isNotNull() | has(x, LINES["card"])
            plus = F.when(f["second"].isNotNull(), "_plus").otherwise("")
            name = F.concat(F.lit("flash:"), F.when(f["first"].isNotNull(), F.concat(F.replace(f["first"], F.lit("!"), F.lit("")), plus)).otherwise("flash_generic"))
            return F.when(card, F.coalesce(let(part(x, LINES["card_gen"], 1), lambda gen: line(name, digits(gen), gen)), line(F.when(f["first"].isNotNull(), name), F.lit("0"), F.lit("0"))))

        return F.coalesce(
            let(one("buds"), lambda buds: F.when(buds.isNotNull(), line(maker, buds))), line(F.lit("airpods"), one("airpods")),
            two("iphone", lambda p: line(F.lit("iphone"), p["first"], F.concat(p["first"].cast("int").cast("string"), F.coalesce(tight(p["second"]), F.lit(""))))),
            two("pixel", lambda p: line(F.lit("pixel"), digits(p["first"]), F.concat(p["first"], F.coalesce(p["second"], F.lit(""))))),
            let(one("sony"), lambda sony: line(F.lit("sony_wh1000xm"), sony, F.concat(F.lit("xm"), sony))), two("canvas", of_flash, may_have(low, LINES["canvas"]) | may_have(low, LINES["card"])),
            let(one("dyson"), lambda dryer: F.when(dryer.isNotNull(), let(part(x, LINES["dyson_gen"], 1), lambda model: line(F.concat(F.lit("dyson:"), dryer), model, F.concat(F.lit("hd"), model))))),
            two("tool", lambda p: line(F.concat(F.lit("tool:"), p["first"]), above(digits(p["second"])), F.concat(p["first"], p["second"])), low.rlike("[0-9]v")),
            F.when(may_have(low, LINES["robot"]) & has(x, LINES["robot"]), let(tight(part(x, LINES["robot_gen"], 1)), lambda robot: line(F.lit("robot:model"), above(F.regexp_extract(robot, r"\d+", 0)), robot))),
        )

    return let(let(spaced(F.lower(title)), lambda x: F.struct(x.alias("x"), folded(x).alias("low"))), told)


def _without(x: Column, literal: Column) -> Column:
    """x without any case of a literal (null: as it is)."""
    return F.when(literal.isNull(), x).otherwise(F.regexp_replace(x, F.concat(F.lit(r"(?iu)\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(" ")))


def _first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(spaced(x), " "), lambda w: w != ""), 1, n), " ")


def entity_of(title: Column, specs: Column | None = None) -> Column:
    """struct(entity, brand, role, host, family, noun, confidence): whether a title is a device of its own or a part, supply or accessory of a host, and what
    it is for. A host that is sold with accessories stays a host."""
    family = lambda x, low=None: first_rule(x, [(f, p) for f, p, _ in HOSTS], low)
    host_words = lambda v: F.coalesce(*[F.when(may_have(v["low"], p) & v["x"].rlike(rx(p)), F.coalesce(spaced(part(v["x"], c, 1)), F.lit("")) if c else F.lit("")) for _, p, c in HOSTS])
    phrase = lambda x, low=None: let(F.struct(x.alias("x"), (folded(x) if low is None else low).alias("low")), host_words)
    field = lambda index, table, k: F.coalesce(*[F.when(index == str(i), F.lit(row[k])) for i, row in enumerate(table)])
    none = F.lit(None).cast("string")

    may = lambda low, pattern: may_have(low, pattern) if needed(pattern) else F.lit(True)

    def read(x: Column) -> Column:
        name, text, low = x["name"], x["text"], x["low"]
        said = F.when(may(low, FOR_HOST), F.nullif(F.substring(_first_words(F.regexp_extract(name, "(?s)" + rx(FOR_HOST) + "(.*)$", 1), 6), 1, 60), F.lit("")))
        leads = F.when(may(low, HOST_LEAD) & has(name, HOST_LEAD), False).otherwise(may(low, DEPENDENT_LEAD) & has(name, DEPENDENT_LEAD))
        return F.struct(name.alias("name"), text.alias("text"), low.alias("low"), family(name, low).alias("named_family"), said.alias("said"), leads.alias("leads"), t.brand_of(text, HOST_BRANDS).alias("brand"))

    def signals(x: Column) -> Column:
        in_title, of_host = x["named_family"].isNotNull(), x["said"].isNotNull() | x["leads"]
        scanned = F.when(in_title & ~of_host, spaced(F.regexp_replace(x["name"], "(?s)" + rx(IN_BUNDLE) + ".*$", ""))).otherwise(x["text"])
        of_text = ~x["name"].eqNullSafe(x["text"])  # where they are alike, what one lacks the other lacks
        host = F.nullif(F.when(in_title, phrase(x["name"], x["low"])).when(of_text, phrase(x["text"])), F.lit(""))
        rules = lambda table, k, v: first_rule(v["x"], [(str(i), row[k]) for i, row in enumerate(table)], v["low"])
        read = lambda v: F.struct(rules(ROLES, 2, v).alias("role"), rules(HINTS, 4, v).alias("hint"))
        found = let(let(scanned, lambda v: F.struct(v.alias("x"), folded(v).alias("low"))), read)
        return F.struct(
            x.alias("x"), host.alias("host"), F.coalesce(x["named_family"], F.when(of_text, family(x["text"]))).alias("family"), (in_title & ~of_host).alias("device"), found.alias("found")
        )

    def decided(y: Column) -> Column:
        # all roles of the tables are dependent ones: a device with such words is a device in a bundle
        bundled = y["device"] & (y["found"]["role"].isNotNull() | y["found"]["hint"].isNotNull())
        role = F.when(bundled, "primary").otherwise(F.coalesce(field(y["found"]["hint"], HINTS, 1), field(y["found"]["role"], ROLES, 0), F.lit("primary")))
        noun = F.when(~bundled, F.coalesce(field(y["found"]["hint"], HINTS, 3), field(y["found"]["role"], ROLES, 1)))
        hinted = y["found"]["hint"].isNotNull() & ~bundled
        return F.struct(
            y.alias("y"), role.alias("role"), noun.alias("noun"), F.when(hinted, field(y["found"]["hint"], HINTS, 0)).alias("hinted"),
            F.coalesce(F.when(hinted, field(y["found"]["hint"], HINTS, 2)), y["family"], field(y["found"]["hint"], HINTS, 2)).alias("family"), F.coalesce(y["x"]["said"], y["host"]).alias("host"),
        )

    def stripped(x: Column, text: Column, host: Column | None) -> Column:
        left = x
        words = lambda low: F.struct(*[F.when(may(low, p), F.lower(part(text, p))).alias(f"w{i}") for i, p in enumerate(MARKETING)])

        def without(found: Column) -> Column:
            left = x
            for i in range(len(MARKETING)):
                left = _without(left, found[f"w{i}"])
            return left if host is None else _without(left, host)

        plain = lambda v: F.when(may(v["low"], FOR_HOST), F.regexp_replace(v["x"], "(?s)^(.*?)" + rx(FOR_HOST), "$1 ")).otherwise(v["x"])
        quiet = lambda v: F.when(may(v["low"], ENTITY_NOISE), F.regexp_replace(plain(v), rx(ENTITY_NOISE), " ")).otherwise(plain(v))
        return spaced(let(let(let(folded(text), words), without), lambda left: let(F.struct(left.alias("x"), folded(left).alias("low")), quiet)))

    def told(z: Column) -> Column:
        x, noun, dependent = z["y"]["x"], z["noun"], z["role"] != "primary"
        text = x["text"]
        words = F.slice(F.filter(F.split(stripped(text, text, z["host"]), " "), lambda w: (F.length(w) > 1) & (noun.isNull() | (F.lower(w) != F.lower(noun)))), 1, 5)
        own = lambda ws: F.when(x["brand"].isNotNull() & ~F.exists(ws, lambda w: F.lower(w) == x["brand"]), x["brand"])
        from_words = let(words, lambda ws: F.substring(spaced(F.concat_ws(" ", own(ws), noun, F.array_join(ws, " "))), 1, 80))
        device = F.coalesce(z["y"]["host"], _first_words(stripped(x["name"], text, None), 5))
        entity = F.when(z["hinted"].isNotNull(), F.when(noun.isNotNull() & dependent, F.concat_ws(" ", noun, z["hinted"])).otherwise(z["hinted"])).when(dependent, from_words).otherwise(device)
        sure = (
            F.when(z["hinted"].isNotNull(), 0.85).when(dependent, F.when(z["y"]["found"]["role"].isNotNull() & z["family"].isNotNull(), 0.75).when(z["y"]["found"]["role"].isNotNull(), 0.6).otherwise(0.45))
            .when(z["y"]["family"].isNotNull(), 0.7).otherwise(0.4)
        )
        empty = (F.coalesce(text, F.lit("")) == "") | (text == PLACEHOLDER)
        return F.struct(
            F.when(empty, "").otherwise(spaced(entity)).alias("entity"), F.when(empty, none).otherwise(x["brand"]).alias("brand"), F.when(empty, "primary").otherwise(z["role"]).alias("role"),
            F.when(empty, none).otherwise(F.substring(spaced(z["host"]), 1, 60)).alias("host"), F.when(empty, none).otherwise(z["family"]).alias("family"), F.when(empty, none).otherwise(noun).alias("noun"),
            F.when(empty, 0.0).otherwise(sure).alias("confidence"),
        )

    both = F.struct(spaced(title).alias("name"), spaced(F.concat_ws(" ", title, specs) if specs is not None else title).alias("text"))
    given = let(both, lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text"), folded(x["name"]).alias("low")))
    return let(let(let(let(given, read), signals), decided), told)


def entity_query(e: Column) -> Column:
    """What to search for: brand and noun, unless the entity says them, and the entity."""
    low = F.lower(e["entity"])
    missing = lambda c: F.when(c.isNotNull() & ~low.contains(F.lower(c)), c)
    return F.when(e["entity"] == "", "").otherwise(F.substring(spaced(F.concat_ws(" ", missing(e["brand"]), missing(e["noun"]), e["entity"])), 1, 80))


def entity_query_with_host(e: Column) -> Column:
    """The entity's query and the host's first three words, or null."""
    lead, short = entity_query(e), _first_words(e["host"], 3)
    return F.when((lead != "") & (F.coalesce(short, F.lit("")) != "") & ~F.lower(lead).contains(F.lower(short)), F.substring(F.concat_ws(" ", lead, short), 1, 80))


def model_of(title: Column, entity: Column) -> Column:
    """struct(model, query): of a dependent product its entity, else the first model name, else the title's leading words."""
    x = F.trim(title)
    leading = F.array_join(F.slice(F.filter(F.split(spaced(F.regexp_replace(x, rx(TITLE_NOISE), "")), " "), lambda w: F.length(w) > 2), 1, 6), " ")
    named = let(F.struct(x.alias("x"), folded(x).alias("low")), lambda v: F.coalesce(*[F.when(may_have(v["low"], p), part(v["x"], p)) for p in MODELS]))
    dependent = (entity["role"] != "primary") & (F.length(entity["entity"]) >= 3)
    found = F.struct(x.alias("x"), t.brand_of(x).alias("brand"), spaced(F.when(~F.coalesce(dependent, F.lit(False)), named)).alias("named"), F.when(F.coalesce(dependent, F.lit(False)), entity_query(entity)).alias("lead"))
    read = let(found, lambda v: F.struct(v["x"].alias("x"), v["brand"].alias("brand"), v["named"].alias("named"), F.when(v["named"].isNull(), leading).alias("leading"), v["lead"].alias("lead")))

    def told(r: Column) -> Column:
        full = F.when(r["brand"].isNotNull() & ~F.lower(r["named"]).contains(r["brand"]), F.concat_ws(" ", r["brand"], r["named"])).otherwise(r["named"])
        empty = (F.coalesce(r["x"], F.lit("")) == "") | (r["x"] == PLACEHOLDER)
        ladder = lambda of_dependent, of_named, of_leading: F.when(empty, "").when(dependent, of_dependent).when(r["named"].isNotNull(), of_named).otherwise(of_leading)
        short = F.substring(entity["entity"], 1, 80)
        return F.struct(ladder(short, r["named"], r["leading"]).alias("model"), ladder(F.when(r["lead"] != "", r["lead"]).otherwise(short), F.substring(full, 1, 80), F.substring(r["leading"], 1, 80)).alias("query"))

    return let(read, told)


def match_tokens(title: Column) -> Column:
    """Different tokens that tell products apart: graphics chips, model codes of five characters or more, words of four or more that aren't stop words."""

    def found(x: Column) -> Column:
        chip = lambda name: F.concat(F.lit(name), part(x, rf"{name}\s*(\d{{3,4}})", 1))
        codes = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"[a-z]{1,4}-?[a-z]?\d{3,6}[a-z0-9]*"), F.lit(0)), lambda c: F.replace(c, F.lit("-"), F.lit(""))), lambda c: F.length(c) >= 5)
        words = F.filter(F.split(x, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*t.STOP_WORDS))
        return F.array_distinct(F.concat(F.filter(F.array(chip("rtx"), chip("gtx")), lambda c: c.isNotNull()), codes, words))

    return F.when((F.coalesce(title, F.lit("")) == "") | (title == PLACEHOLDER), F.array().cast("array<string>")).otherwise(let(t.normal_title(title), found))


#: Marks that penalties between categories look at: name and pattern.
MARKS = {
    "accessory": r"чехол|(?:^|[\s,./_-])(?:case|cover|sleeve|pouch|skin|holder|stand|charger|adapter)(?:$|[\s,./_-])|\bsoft\s+(?:tpu\s+)?case\b|\bprotective\s+case\b|\bsilicone\s+case\b|\blaptop\s+(?:sleeve|bag|case)\b|\bnotebook\s+(?:sleeve|bag|case)\b|"
    r"\btempered\s+glass\b|\bscreen\s+protector\b|\bcharging\s+cable\b|\b(?:usb[-\s]?c|lightning|type[-\s]?c)\s+cable\b|защитн\w*\s+(?:стекл|плёнк|пленк)|плёнк|пленк|кабель|зарядк|зарядн|держатель|подставк|сумк\w*\s+для\s+(?:ноут|laptop)|сумка\s+для\s+ноут",
    "device": r"смартфон|ноутбук|laptop|macbook|notebook|ultrabook|моноблок|телевизор|\bsmart\s*tv\b|монитор|\bmonitor\b|\bsmartphone\b",
    "phone_brand": r"\b(?:iphone|galaxy|pixel|redmi|xiaomi|poco|realme|honor|huawei|samsung)\b",
    "laptop": r"ноутбук|laptop|macbook|notebook|ultrabook",
    "monoblock": r"моноблок|all[-\s]?in[-\s]?one|\baio\b|моноблочн",
    "desktop": r"мини[-\s]?пк|mini[-\s]?pc|неттоп|\bnuc\b|системн\w*\s*блок|игровой\s+компьютер|\bdesktop\b|пк\s+игровой|игровой\s+пк\b",
    "component": r"(?:^|[\s,./])(?:оперативн\w*\s+память|модуль\s+памяти|материнск\w*\s+плат|блок\s+питания|\bpsu\b|видеокарт|\bgpu\b|процессор(?!\s+для\s+ноут)|cooler\s+master|thermal\s+paste)(?=$|[\s,./])",
    "intruder": r"видеокарт|\bgpu\b|графическ|трафарет|наклейк|стикер|системн\w*\s*блок|игровой\s+компьютер|пк\s+сборк|мини[-\s]?пк|mini[-\s]?pc",
    "chip": r"видеокарт|\bgpu\b",
    "graphics": r"видеокарт|\bgpu\b|графическ",
    "stencil": r"видеокарт|\bgpu\b|трафарет",
    "tower": r"игровой\s+компьютер|системн\w*\s*блок",
    "tv": r"телевизор|\bsmart\s*tv\b|\bUE\d{2}|\bQN\d{2}",
    "tv_word": r"телевизор",
    "smart_tv": r"телевизор|\bsmart\s*tv\b",
    "monitor": r"монитор|\bmonitor\b",
    "fits": r"совместим[а-яёa-z]*|(?:для|for)\s+(?:[a-z][a-z0-9\-]*|[а-яёa-z0-9\-]*\d[а-яёa-z0-9\-]*)",
}
#: Bodies of cameras.
BODIES = (r"\bcanon\s+eos\s*(\d{3,4})\s*d?\b", r"\beos\s*(\d{3,4})\s*d\b", r"\bcanon\s+(\d{3,4})\s*d\b", r"\bnikon\s+d(\d{3,4})\b")


def marks_of(x: Column) -> Column:
    def told(v: Column) -> Column:
        x, low = v["x"], v["low"]
        body = F.coalesce(*[F.when(may_have(low, p), part(x, p)) for p in BODIES])
        return F.struct(*[F.coalesce(may_have(low, p) & x.rlike(rx(p)), F.lit(False)).alias(name) for name, p in MARKS.items()], F.regexp_replace(F.lower(body), r"\s+", "").alias("body"))

    return let(F.struct(x.alias("x"), folded(x).alias("low")), told)


_built: dict[tuple, Column] = {}


def spread(titles: DataFrame) -> DataFrame:
    """titles dealt to every core: a title's features take milliseconds, so a file that one task would read keeps all others waiting."""
    spark = titles.sparkSession
    return titles.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _told(rows: DataFrame, texts: list[str], **told: Column) -> DataFrame:
    """Each different text of rows, as columns of_..., with the columns told: computed once, on every core, and stored."""
    return stored(spread(rows.select(*texts).distinct()).select(*[F.col(c).alias(f"of_{c}") for c in texts], *[c.alias(name) for name, c in told.items()]), "told")


def _meet(rows: DataFrame, texts: list[str], known: DataFrame) -> DataFrame:
    """Met by sorting both: files of texts and features are small, for they repeat, but would not be small in the driver and every executor."""
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in texts]
    return rows.join(known.hint("merge"), functools.reduce(lambda x, y: x & y, same)).drop(*[f"of_{c}" for c in texts])


def with_told(rows: DataFrame, texts: list[str], **told: Column) -> DataFrame:
    """rows with columns told, which depend on the columns texts alone: computed once for each different text, on every core, and stored, then joined (null is a text like others)."""
    return _meet(rows, texts, _told(rows, texts, **told))


def numbered(rows: DataFrame, texts: list[str], **told: Column) -> tuple[DataFrame, DataFrame]:
    """rows with `text`, a number for each different text; and what is told of each number (text and the columns told), so that rows can meet by numbers and stay narrow."""
    known = _told(rows, texts, text=F.monotonically_increasing_id(), **told)
    return _meet(rows, texts, known.select(*[f"of_{c}" for c in texts], "text")), known.select("text", *told)


def features_of(title: str, specs: str | None = None, only: tuple[str, ...] = ()) -> Column:
    """features() of named columns; built once a session, for it is a large expression."""
    key = SparkContext._active_spark_context.applicationId, title, specs, only
    if key not in _built:
        _built[key] = features(F.col(title), F.col(specs) if specs else None, only)
    return _built[key]


def features(title: Column, specs: Column | None = None, only: tuple[str, ...] = ()) -> Column:
    """All that pairs of titles are compared by, as a struct, or only the fields named; select it once per title, before any join."""
    text = F.concat_ws(" ", title, F.coalesce(specs, F.lit(""))) if specs is not None else F.concat(F.coalesce(title, F.lit("")), F.lit(" "))

    fields = {
        "title": lambda x: x["title"], "brand": lambda x: t.brand_of(x["title"]), "category": lambda x: category_of(x["text"]), "storage": lambda x: F.coalesce(x["memory"], t.storage(x["text"])), "variant_storage": lambda x: x["memory"],
        "color": lambda x: color_of(x["text"]), "volume": lambda x: t.volume_ml(x["text"]), "weight": lambda x: weight_g(x["text"]), "package_count": lambda x: t.package_count(x["text"]), "size": lambda x: size_of(x["text"]),
        "series": lambda x: series_of(x["text"]), "gender": lambda x: first_rule(F.lower(x["text"]), GENDERS), "material": lambda x: material_of(x["text"]), "mpn": lambda x: part_number_of(x["text"]), "connector": lambda x: connector_of(x["text"]),
        "condition": lambda x: condition_of(x["text"]), "authenticity": lambda x: authenticity_of(x["text"]), "region": lambda x: region_of(x["text"]), "edition": lambda x: edition_of(x["text"]), "scent": lambda x: scent_of(x["text"]),
        "line": lambda x: lineage_of(x["title"]), "marks": lambda x: marks_of(x["title"]), "tokens": lambda x: match_tokens(x["title"]), "words": lambda x: t.title_words(x["title"]),
        "e": lambda x: let(entity_of(x["title"], x["specs"]), lambda e: F.struct(e.alias("entity"), model_of(x["title"], e).alias("model"))),
    }
    memory = storage_variant(text) if not only or {"storage", "variant_storage"} & set(only) else F.lit(None).cast("string")
    given = F.struct(title.alias("title"), (specs if specs is not None else F.lit(None).cast("string")).alias("specs"), text.alias("text"), memory.alias("memory"))
    return let(given, lambda x: F.struct(*[told(x).alias(name) for name, told in fields.items() if not only or name in only]))
