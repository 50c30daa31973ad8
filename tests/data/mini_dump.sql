-- A small dump with the statement forms the reader has to know.
SET NAMES utf8;
/* tables are made elsewhere */
INSERT INTO `dim_campaigns` VALUES ('C1','Alpha','2023-11-12','2023-11-18'),('C2','Beta','2024-01-10','2024-01-16');
INSERT INTO `dim_products` VALUES ('X','Widget (1KG)','Home & Kitchen'),('Y','Gadget, large','B'),('Z','Widget (1KG)','Home & Kitchen'),('Q','Bob\'s (big) box','C');
INSERT INTO `dim_stores` VALUES ('S1','North'),('S2','North'),('S3','South');
INSERT INTO `other_table` VALUES (1,'INSERTED; not wanted');
INSERT INTO `fact_events` VALUES ('e1','S1','C1','X',100,'BOGOF',10,20),('7.5E+11','S2','C1','Y',3000,'500 Cashback',5,8),('e3','S3','C1','X',100,'50% OFF',10,15);
insert into fact_events (store_id, event_id, campaign_id, product_code, base_price, promo_type, `quantity_sold(before_promo)`, `quantity_sold(after_promo)`)
values ('S1','e4','C2','Y',3000,'33% OFF',4,6),
  ('S3', 'e6', 'C2', 'X', 100, NULL, 7, 9);
