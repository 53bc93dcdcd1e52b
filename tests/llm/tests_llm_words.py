"""Sentences of which test corpora are made."""

CHINESE = ["据统计，这一批产品共抽检{}份，合格率为{}%。", "由于原料涨价，企业的订单均价约为{}亿元，较去年多出{}万件。", "用户更看重设备的耐用程度，样本量为{}，误差不超过{}%。", "从口岸看，通关时间缩短到{}小时，覆盖{}个县区。", "采购方把交期压到{}天，成本下降{}%。", "研究所与供应链合建中试基地，预计{}年后恢复，其中占{}%。"]
ENGLISH = ["According to the panel, the unit cost was restated by {} million, within {} percent of error. ", "Buyers cut the lead time of each cabinet to {} days, though stocks remain a weak spot in {} regions. ", "The firm vows to convert its plants by {}, and the market has grown by {} percent. ", "In the north, inspectors turned away {} lots of film, of which the group holds {} percent. "]
GERMAN = ["Für Käufer verschob der Händler den Ausbau auf {}, bei {} Prozent Abweichung. ", "Laut Prüfstelle gehören {} Prozent der Beschäftigten zur Entwicklung, rund {} mehr als zuvor. ", "Im Überblick erhöhte das Werk die Menge um {} Stück, trotz höherer Löhne in {} Betrieben. "]
