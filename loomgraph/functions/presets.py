"""Word lists, lookup tables and formats that results depend on."""

# fixed values: tokens that mean "no value", compared in lower case after trimming
NULL_TOKENS = ["", "nan", "none", "null", "/", "-", "—", "n/a", "无", "暂无"]

# fixed values: separators of multi-value cells
MULTI_VALUE_PATTERN = "[;；|\n]+"

# fixed values: organisation type keywords and names
SCHOOL_WORDS = ["大学", "学院", "University", "College", "学校"]
RESEARCH_WORDS = ["研究所", "研究院", "实验室", "Research", "Institute", "Laboratory"]
ORG_TYPES = {"school": "高校", "research": "研究机构", "company": "公司", "other": "机构"}

# fixed values: suffixes removed one after the other before names are compared
COMPARISON_SUFFIXES = [
    "co., ltd.", "co.,ltd.", "co. ltd.", "co.ltd.",
    "inc.", "corp.", "corporation", "limited", "ltd.",
    "gmbh", "ag", "s.a.", "llc", "plc",
    "有限公司", "股份有限公司", "集团", "株式会社",
]

# fixed values: suffixes of which the first that fits is removed before names are encoded
EMBEDDING_SUFFIXES = [
    "有限公司", "股份有限公司", "有限责任公司", "集团有限公司", "集团", "总公司",
    "co., ltd.", "co.,ltd.", "co. ltd.", "co.ltd.", "corporation", "corp.",
    "inc.", "incorporated", "limited", "ltd.", "llc", "l.l.c.", "plc",
    "gmbh", "ag", "e.v.", "mbh", "kg", "ohg",
    "s.a.", "s.a.s.", "sarl", "s.a.r.l.", "sas",
    "株式会社", "合同会社", "有限会社",
    "주식회사",
]

# fixed values: words that make a short Han name an organisation
ORG_WORDS = ["公司", "集团", "大学", "学院", "研究", "中心", "协会"]

# fixed values: special regions of the home country
SPECIAL_REGIONS = {
    "香港": "中国香港",
    "澳门": "中国澳门",
    "台湾": "中国台湾",
    "Hong Kong": "中国香港",
    "Macao": "中国澳门",
    "Macau": "中国澳门",
    "Taiwan": "中国台湾",
    "HK": "中国香港",
}
HOME_COUNTRY = "中国"

# fixed values: province key -> full name; the first four are municipalities
MUNICIPALITIES = ["北京", "上海", "天津", "重庆"]
PROVINCES = {
    "北京": "北京市", "上海": "上海市", "天津": "天津市", "重庆": "重庆市",
    "广东": "广东省", "江苏": "江苏省", "浙江": "浙江省", "山东": "山东省",
    "河南": "河南省", "四川": "四川省", "湖北": "湖北省", "湖南": "湖南省",
    "河北": "河北省", "福建": "福建省", "安徽": "安徽省", "辽宁": "辽宁省",
    "陕西": "陕西省", "江西": "江西省", "广西": "广西壮族自治区", "云南": "云南省",
    "山西": "山西省", "贵州": "贵州省", "黑龙江": "黑龙江省", "吉林": "吉林省",
    "甘肃": "甘肃省", "内蒙古": "内蒙古自治区", "新疆": "新疆维吾尔自治区",
    "海南": "海南省", "宁夏": "宁夏回族自治区", "青海": "青海省", "西藏": "西藏自治区",
}

# fixed values: patterns (case ignored) of foreign countries
FOREIGN_PATTERNS = {
    r"Japan|日本|株式会社|合同会社": "日本",
    r"Korea|韩国|주식회사": "韩国",
    r"USA|United States|美国|Inc\.|Corp\.": "美国",
    r"Germany|德国|GmbH|AG(?![a-z])": "德国",
    r"France|法国|S\.A\.|SARL": "法国",
    r"UK|United Kingdom|英国|Ltd\.(?!\s*公司)": "英国",
    r"Canada|加拿大": "加拿大",
    r"Australia|澳大利亚|澳洲": "澳大利亚",
    r"Italy|意大利": "意大利",
    r"Spain|西班牙": "西班牙",
    r"Netherlands|荷兰": "荷兰",
    r"Sweden|瑞典": "瑞典",
    r"Switzerland|瑞士": "瑞士",
    r"Russia|俄罗斯": "俄罗斯",
    r"India|印度": "印度",
    r"Singapore|新加坡": "新加坡",
}

# fixed values: confidence of the place rules; the caller keeps what is above the floor
PLACE_CONFIDENCE = {"special": 0.95, "province": 0.85, "city": 0.90, "foreign": 0.85}
PLACE_CONFIDENCE_FLOOR = 0.8

# fixed values: country -> place id code
COUNTRY_CODES = {
    "中国": "cn", "日本": "jp", "韩国": "kr", "美国": "us", "德国": "de", "法国": "fr",
    "英国": "uk", "加拿大": "ca", "澳大利亚": "au", "意大利": "it", "西班牙": "es",
    "荷兰": "nl", "瑞典": "se", "瑞士": "ch", "俄罗斯": "ru", "印度": "in", "新加坡": "sg",
}

# fixed values: place name without its last unit sign -> short code
PLACE_ABBREVIATIONS = {
    "北京": "bj", "上海": "sh", "天津": "tj", "重庆": "cq",
    "广东": "gd", "江苏": "js", "浙江": "zj", "山东": "sd",
    "河南": "hn", "四川": "sc", "湖北": "hb", "湖南": "hun",
    "河北": "heb", "福建": "fj", "安徽": "ah", "辽宁": "ln",
    "陕西": "sx", "江西": "jx", "广西": "gx", "云南": "yn",
    "山西": "shx", "贵州": "gz", "黑龙江": "hlj", "吉林": "jl",
    "甘肃": "gs", "内蒙古": "nmg", "新疆": "xj", "海南": "hain",
    "宁夏": "nx", "青海": "qh", "西藏": "xz",
    "广州": "gz", "深圳": "sz", "杭州": "hz", "南京": "nj",
    "武汉": "wh", "成都": "cd", "西安": "xa", "苏州": "suz",
    "中国香港": "hk", "中国澳门": "mo", "中国台湾": "tw",
}

# fixed values: region cascade over party names (city before province where both may occur)
PARTY_REGIONS = [
    ("北京", "北京"), ("上海", "上海"), ("深圳", "广东"), ("广州", "广东"), ("广东", "广东"),
    ("江苏", "江苏"), ("南京", "江苏"), ("苏州", "江苏"), ("无锡", "江苏"), ("浙江", "浙江"),
    ("杭州", "浙江"), ("宁波", "浙江"), ("山东", "山东"), ("青岛", "山东"), ("济南", "山东"),
    ("四川", "四川"), ("成都", "四川"), ("湖北", "湖北"), ("武汉", "湖北"), ("陕西", "陕西"),
    ("西安", "陕西"), ("天津", "天津"), ("重庆", "重庆"), ("安徽", "安徽"), ("合肥", "安徽"),
    ("河南", "河南"), ("郑州", "河南"), ("湖南", "湖南"), ("长沙", "湖南"), ("福建", "福建"),
    ("厦门", "福建"), ("福州", "福建"), ("辽宁", "辽宁"), ("大连", "辽宁"), ("沈阳", "辽宁"),
    ("河北", "河北"), ("吉林", "吉林"), ("长春", "吉林"), ("黑龙江", "黑龙江"), ("哈尔滨", "黑龙江"),
    ("江西", "江西"), ("南昌", "江西"), ("山西", "山西"), ("太原", "山西"), ("云南", "云南"),
    ("昆明", "云南"), ("贵州", "贵州"), ("贵阳", "贵州"), ("广西", "广西"), ("南宁", "广西"),
    ("甘肃", "甘肃"), ("兰州", "甘肃"), ("内蒙古", "内蒙古"), ("呼和浩特", "内蒙古"), ("新疆", "新疆"),
    ("乌鲁木齐", "新疆"), ("海南", "海南"), ("海口", "海南"), ("宁夏", "宁夏"), ("银川", "宁夏"),
    ("青海", "青海"), ("西宁", "青海"), ("西藏", "西藏"), ("拉萨", "西藏"), ("香港", "香港"),
    ("澳门", "澳门"), ("台湾", "台湾"),
]
OTHER_REGION = "其他/海外"

# fixed values: topics, and the words that lead to one of them
TOPICS = ["制氢技术", "储氢技术", "物理储氢", "合金储氢", "无机储氢", "有机储氢", "氢燃料电池", "氢制冷"]
TOPIC_WORDS = {
    "制氢": "制氢技术", "储氢": "储氢技术", "物理储": "物理储氢", "合金储": "合金储氢", "无机储": "无机储氢",
    "有机储": "有机储氢", "燃料电池": "氢燃料电池", "氢电池": "氢燃料电池", "氢冷": "氢制冷", "制冷": "氢制冷",
}

# fixed values: topic tree as child -> parent
ROOT_TOPIC = "氢能技术"
TOPIC_PARENTS = {
    "制氢技术": "氢能技术", "储氢技术": "氢能技术", "氢燃料电池": "氢能技术", "氢制冷": "氢能技术",
    "物理储氢": "储氢技术", "合金储氢": "储氢技术", "无机储氢": "储氢技术", "有机储氢": "储氢技术",
}

# fixed values: file name -> topic, exact names first, then ordered parts of the name
FILE_TOPICS = {
    "2.6.1制氢技术-1": "制氢技术", "2.6.1制氢技术-2": "制氢技术", "2.6.2.1物理储氢": "物理储氢",
    "2.6.2.2合金储氢": "合金储氢", "2.6.2.3无机储氢-1": "无机储氢", "2.6.2.3无机储氢-2": "无机储氢",
    "2.6.2.4有机储氢": "有机储氢", "2.6.3氢燃料电池": "氢燃料电池", "2.6.4氢制冷": "氢制冷",
}
FILE_TOPIC_PARTS = [
    ("制氢", "制氢技术"), ("物理储氢", "物理储氢"), ("合金储氢", "合金储氢"), ("无机储氢", "无机储氢"),
    ("有机储氢", "有机储氢"), ("储氢", "储氢技术"), ("燃料电池", "氢燃料电池"), ("氢制冷", "氢制冷"),
]

# fixed values: legal states, and the words that lead to one of them
LEGAL_STATES = ["有效", "无效", "审中", "授权", "撤回", "驳回", "视为撤回", "失效", "放弃", "公开"]
LEGAL_STATE_WORDS = {
    "有效专利": "有效", "授权专利": "授权", "失效专利": "失效", "审查中": "审中", "正在审查": "审中", "已授权": "授权",
    "已公开": "公开", "被驳回": "驳回", "被撤回": "撤回", "主动撤回": "撤回", "视撤": "视为撤回", "已放弃": "放弃",
}
COLLOQUIAL_REGIONS = {"帝都": "北京", "魔都": "上海", "羊城": "广州", "鹏城": "深圳"}

# fixed values: words that make a sentence a key sentence
KEY_WORDS = [
    "氢", "hydrogen", "电解", "electrolysis", "燃料电池", "fuel cell",
    "储氢", "storage", "催化", "catalyst", "膜", "membrane",
    "效率", "efficiency", "方法", "method", "装置", "device", "系统", "system",
]

# fixed values: descriptions of classification prefixes
CODE_DESCRIPTIONS = {
    "H01M": "电池; 燃料电池", "H01M8": "燃料电池; 其零部件", "C01B": "非金属元素; 其化合物",
    "C01B3": "氢; 含氢混合气体", "C25B": "电解方法; 电解装置", "C25B1": "电解生产无机化合物或非金属",
    "B01D": "分离; 物理或化学方法", "B01J": "催化剂; 胶体", "F17C": "压力容器; 气体储存",
    "F25B": "制冷机; 热泵", "C07C": "无环或碳环化合物", "C10L": "燃料; 润滑剂",
    "A": "人类生活必需", "B": "作业; 运输", "C": "化学; 冶金", "D": "纺织; 造纸",
    "E": "固定建筑物", "F": "机械工程; 照明; 加热", "G": "物理", "H": "电学",
}

# fixed values: sheet header -> field name
SHEET_COLUMNS = {
    "序号": "seq_no", "申请号": "application_no", "申请日": "application_date", "专利类型": "patent_type",
    "公开（公告）日": "publication_date", "当前法律状态": "legal_status", "标题 (中文)": "title_cn",
    "标题 (英文)": "title_en", "摘要 (中文)": "abstract_cn", "摘要 (英文)": "abstract_en", "申请人": "applicants",
    "当前权利人": "current_rights_holders", "公开（公告）号": "publication_no", "公开国别": "publication_country",
    "IPC主分类": "ipc_main", "简单同族": "patent_family", "转让次数": "transfer_count", "转让人": "transferors",
    "受让人": "transferees", "许可次数": "license_count", "许可人": "licensors", "被许可人": "licensees",
    "当前被许可人": "current_licensees", "质押/保全次数": "pledge_count", "出质人": "pledgors", "质权人": "pledgees",
    "当前质权人": "current_pledgees", "诉讼次数": "litigation_count", "诉讼类型": "litigation_types",
    "原告": "plaintiffs", "被告": "defendants",
}

# fixed values: party roles of a record and the edge each becomes
ROLE_EDGES = {
    "applicants": "APPLIED_BY",
    "current_rights_holders": "OWNED_BY",
    "transferors": "TRANSFERRED_FROM",
    "transferees": "TRANSFERRED_TO",
    "licensors": "LICENSED_FROM",
    "licensees": "LICENSED_TO",
    "current_licensees": "CURRENT_LICENSED_TO",
    "pledgors": "PLEDGED_FROM",
    "pledgees": "PLEDGED_TO",
    "current_pledgees": "CURRENT_PLEDGED_TO",
    "plaintiffs": "LITIGATED_WITH",
    "defendants": "LITIGATED_WITH",
}
LITIGATION_ROLES = {"plaintiffs": "原告", "defendants": "被告"}

# fixed values: words that mark a line of generated text as query code
CODE_WORDS = [
    "MATCH", "WHERE", "RETURN", "WITH", "ORDER", "LIMIT", "OPTIONAL", "AND", "OR", "AS", "COUNT", "CONTAINS",
    "IN", "DESC", "ASC", "BY", "DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "END", "NOT", "EXISTS", "CALL", "YIELD",
    "SET", "DELETE", "CREATE", "MERGE", "UNWIND",
]
CODE_SIGNS = ["(", ")", "[", "]", "{", "}", "->", "<-", ":"]
