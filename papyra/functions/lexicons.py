"""Word lists for Chinese tender documents. Topics and rules are a caller's own; lists can also come from files (``papyra.sources.lexicon``)."""

from __future__ import annotations

from papyra.operators.requirements import Lexicon

# Words by which a clause rejects, obliges, excludes or sets a criterion, verbs of duties, marks of contents pages,
# words that open lists, subjects of either side, ranks of sources.
STRONG = (
    "否决投标", "否决其投标", "将被否决", "予以否决", "投标被否决", "否决", "废标", "作废标处理", "无效投标", "投标无效", "响应无效", "响应文件无效", "无效响应", "作无效处理", "按无效标处理",
    "不予评审", "不予受理", "实质性要求", "实质性响应", "未实质响应", "重大偏差", "串通投标", "围标", "弄虚作假", "虚假材料", "提供虚假", "伪造", "取消投标资格", "取消中标资格",
)
MANDATORY = (
    "必须", "应当", "不得", "不允许", "不接受", "禁止", "严禁", "须提供", "须提交", "须加盖", "须为", "不低于", "不超过", "不少于", "不得低于", "不得高于",
    "应提供", "应提交", "应满足", "应符合", "应加盖", "应包含", "需提供", "需提交", "均须", "均需", "务必", "一票否决",
)
EXCLUSION = (
    "不得存在下列情形", "不得存在下列", "存在下列情形之一", "不得参加本项目", "不得参加同一", "禁止其参与本项目", "被责令停产停业", "吊销许可证", "吊销执照",
    "失信被执行人", "严重违法失信", "政府采购严重违法", "经营异常名录", "重大税收违法", "处于被禁止参加", "取消其投标资格",
)
CRITERIA = ("评审标准", "评审因素", "评标标准", "审查标准", "评审办法前附表", "资格审查标准", "具备有效的", "与营业执照一致", "符合第二章", "符合询比文件", "符合招标文件")
VERBS = ("提供", "提交", "加盖", "上传", "编制", "填写", "附", "采用", "递交", "缴纳", "出具", "承诺", "响应", "符合", "满足", "具备", "不得", "必须", "应当", "应按", "须", "查询", "签字", "盖章")
NAVIGATION = ("目录", "....", "……", "页码")
GOVERNING = ("下列", "如下", "以下", "情形之一的", "条件之一的")
BUYERS = ("采购人", "招标人", "评审小组", "询比小组", "评标委员会", "评审委员会", "代理机构", "监督部门", "评委")
BIDDERS = ("供应商", "投标人", "响应人", "申请人", "承包人", "成交供应商", "中标人")
SOURCE_RANKS = [(100, "投标人须知前附表"), (90, "招标公告 / 采购公告"), (80, "正文明确字段"), (70, "封面"), (60, "文件名")]

TENDERS = Lexicon(strong=STRONG, mandatory=MANDATORY, exclusion=EXCLUSION, criteria=CRITERIA, verbs=VERBS, navigation=NAVIGATION, governing=GOVERNING, buyers=BUYERS, bidders=BIDDERS)
