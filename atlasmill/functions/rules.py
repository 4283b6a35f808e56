"""Fixed values of the address rules: patterns, word lists and tables, stated as they must be for equal results."""

# --- fixed values -------------------------------------------------------------------------------------------------
SEPARATORS = "[、，,；;]+"
UNIT_FRAGMENT = "[0-9A-Za-z一二三四五六七八九十]{1,4}(栋|座|楼|幢|号楼|单元)([A-Za-z一二三四五六七八九十]{0,3}(单元)?)?"
PURE_TOKEN = "[0-9A-Za-z]{1,4}|[一二三四五六七八九十]{1,3}"
GROUP_SEPARATORS = "[/／,，、.．\\-—－]"
NUMBER_GROUP = "([0-9A-Za-z]{1,4}(?:[/／,，、.．\\-—－][0-9A-Za-z]{1,4})+)(栋|座|楼|幢|号楼|单元)"
LETTER_GROUP = "([A-Za-z]{2,4})(栋|座|楼|幢|单元|号楼)"
ALIAS = "[（(][^（()）]*[)）]"
CJK_RUN = "[\\u4e00-\\u9fa5]{2,}"
UNIT_TOKEN = "[0-9A-Za-z]{1,4}(栋|座|楼|幢|号楼|单元)"
NUMERAL_UNIT = "[一二三四五六七八九十]{1,3}单元?"
UNIT_CHARACTERS = "栋座楼幢号楼单元"
RESIDENTIAL_INPUT = "栋|座|单元|楼|花园|苑|村|公寓|家园|小区|府|阁|居|庭|台|轩|庄"
RESIDENTIAL_TAG = "住宅|楼栋|居住|小区"
COMMERCIAL_TAG = "餐饮|美食|小吃|快餐|蛋糕|购物|超市|便利店|公司|企业|酒店|宾馆|生活服务|美容|健身|药店|金融"
GENERIC_WORDS = (
    "宿舍", "宿舍楼", "教学楼", "办公楼", "项目部", "工业园", "工业区", "商业楼", "综合楼",
    "家属楼", "住宅楼", "大楼", "厂房", "仓库", "基地", "停车场", "大门", "食堂",
)
AREA_DISTRICTS = (
    ("香蜜湖", "福田区"), ("华强北", "福田区"), ("梅林", "福田区"), ("车公庙", "福田区"), ("上下沙", "福田区"),
    ("前海", "南山区"), ("蛇口", "南山区"), ("西丽", "南山区"), ("科技园", "南山区"), ("南油", "南山区"),
    ("华侨城", "南山区"), ("沙河", "南山区"),
    ("石岩", "宝安区"), ("西乡", "宝安区"), ("福永", "宝安区"), ("沙井", "宝安区"), ("松岗", "宝安区"), ("坪洲", "宝安区"),
    ("布吉", "龙岗区"), ("平湖", "龙岗区"),
    ("葵涌", "大鹏新区"), ("大鹏", "大鹏新区"),
)
DISTRICTS = ("福田区", "罗湖区", "南山区", "盐田区", "宝安区", "龙岗区", "龙华区", "坪山区", "光明区", "大鹏新区")
RANGE_SPAN = 12
CITY = "深圳市"
BAND_LIMITS = (12890594.86, 8362377.87, 5591021, 3481989.83, 1678043.12, 0)
BANDS = (
    (1.410526172116255e-8, 8.98305509648872e-6, -1.9939833816331, 200.9824383106796, -187.2403703815547, 91.6087516669843, -23.38765649603339, 2.57121317296198, -0.03801003308653, 17337981.2),
    (-7.435856389565537e-9, 8.983055097726239e-6, -0.78625201886289, 96.32687599759846, -1.85204757529826, -59.36935905485877, 47.40033549296737, -16.50741931063887, 2.28786674699375, 10260144.86),
    (-3.030883460898826e-8, 8.98305509983578e-6, 0.30071316287616, 59.74293618442277, 7.357984074871, -25.38371002664745, 13.45380521110908, -3.29883767235584, 0.32710905363475, 6856817.37),
    (-1.981981304930552e-8, 8.983055099779535e-6, 0.03278182852591, 40.31678527705744, 0.65659298677277, -4.44255534477492, 0.85341911805263, 0.12923347998204, -0.04625736007561, 4482777.06),
    (3.09191371068437e-9, 8.983055096812155e-6, 0.00006995724062, 23.10934304144901, -0.00023663490511, -0.6321817810242, -0.00663494467273, 0.03430082397953, -0.00466043876332, 2555164.4),
    (2.890871144776878e-9, 8.983055095805407e-6, -3.068298e-8, 7.47137025468032, -0.00000353937994, -0.02145144861037, -0.00001234426596, 0.00010322952773, -0.00000323890364, 826088.5),
)
METRES_PER_DEGREE = 111320.0
WORLD_HALF = 20037508.34
CIRCLE_SIDES = 36
STATUS_SUCCESS, STATUS_LOW, STATUS_FAILED = "成功", "低置信度", "失败"
UNKNOWN_TYPE = "未知"
NO_RESULT = "所有查询均无有效结果"
EMPTY_MERGE = "合并多边形为空"
# ------------------------------------------------------------------------------------------------------------------
